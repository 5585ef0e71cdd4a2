"""Append-only history and latest-snapshot tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY_COLUMNS = ["fetched_at", "match_id", "match_date", "match_time", "home_team", "away_team", "pool_code",
                   "outcome_key", "outcome", "odds", "handicap_line", "update_time", "source"]


def live_rows(snapshot: DataFrame) -> DataFrame:
    """History rows of a snapshot: only live ones, so that replayed rows make no movement."""
    live = snapshot.where("snapshot_source = 'live'") if "snapshot_source" in snapshot.columns else snapshot
    return live.select(*[c for c in HISTORY_COLUMNS if c in live.columns]).withColumn("recorded_at", F.current_timestamp())


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a folder's write has ended: its marker is the last file that a job writes."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def _complete_parts(spark: SparkSession, root: str, name: str) -> list[str]:
    """Values of ``name=...`` folders under ``root`` whose write has ended, in order of their end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    marker = lambda folder: spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
    folders = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith(f"{name}=")]
    ended = sorted((fs.getFileStatus(marker(f)).getModificationTime(), f.getName()) for f in folders if fs.exists(marker(f)))
    return [folder.removeprefix(f"{name}=") for _, folder in ended]


def append_history(snapshot: DataFrame, path: str, batch: str) -> bool:
    """Append the live rows of a snapshot as ``batch``; False if that batch is in the history already.

    A batch is a folder of its own, so a repeated or failed append leaves the others as they are, and counts from its
    marker on. Batch names are the writer's, for example a fetch time.
    """
    folder = f"{path}/batch={batch}"
    if _complete(snapshot.sparkSession, folder):
        return False
    rows = live_rows(snapshot)
    writer = rows.write.mode("overwrite")
    (writer.partitionBy("match_date") if "match_date" in rows.columns else writer).parquet(folder)
    return True


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the batches whose append has ended, with ``batch``; one that is being written is not seen."""
    batches = _complete_parts(spark, path, "batch")
    if not batches:
        raise ValueError(f"no complete batch under {path}")
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/batch={b}" for b in batches])
    return rows.withColumn("batch", F.col("batch").cast("string"))


def write_snapshot(snapshot: DataFrame, root: str, version: str) -> str:
    """Write one version of the latest snapshot; a version folder is never its own input, and a complete one stays as it is."""
    path = f"{root}/version={version}"
    if not _complete(snapshot.sparkSession, path):
        snapshot.write.mode("overwrite").parquet(path)
    return path


def read_snapshot(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """A complete version, by default the one completed last."""
    complete = _complete_parts(spark, root, "version")
    version = (complete or [None])[-1] if version is None else version
    if version not in complete:
        raise ValueError(f"no complete version {version} under {root}")
    return spark.read.parquet(f"{root}/version={version}")
