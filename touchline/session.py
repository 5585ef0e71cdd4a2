"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Settings every job wants. Broadcast joins stay under Spark's own size check, skewed
#: sort-merge partitions are split at run time.
CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Removes a query's shuffle files at its end, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(app: str = "touchline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with ``CONF``; explicit ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. A throw-away one is made only when none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _local_folder()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="touchline-checkpoint-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to a table in the checkpoint folder and go on from there.

    Survives executor loss like ``checkpoint()``, which would compute the rows twice (once to count
    them, once to write them), and keeps column pruning and file statistics. The folder's owner
    cleans it up, as with other checkpoints; shuffle files of the write go when it ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/touchline-{uuid.uuid4().hex}"
    former = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("errorifexists").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if former is None else spark.conf.set(CLEANUP, former)
    return spark.read.schema(df.schema).parquet(path)
