"""A table of days whose files are never changed in place.

Layout under ``root``: ``data/day=D/version=V`` holds day D as version V wrote it; ``versions/V`` is the commit of version V, a
small table that names, for every day, the version whose files count. A commit is written after its data in one job, so a reader
that opens the newest complete commit never sees half a version, and a writer that failed before it left nothing to see.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.operators.joins import MATCH_KEY, upsert_results

#: Files of rows without a date.
NO_DAY = "none"


def _committed(spark: SparkSession, root: str) -> list[int]:
    """Versions whose commit is complete, ascending."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/versions")
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path)]
    return sorted(int(p.getName()) for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def latest(spark: SparkSession, root: str) -> int | None:
    return (_committed(spark, root) or [None])[-1]


def _pointers(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.schema("day string, version bigint").parquet(f"{root}/versions/{version}")


def _day() -> F.Column:
    return F.coalesce(F.col("date").cast("date").cast("string"), F.lit(NO_DAY))


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The table at a version, by default the newest."""
    version = latest(spark, root) if version is None else version
    if version is None:
        raise ValueError(f"no version under {root}")
    data = spark.read.option("basePath", f"{root}/data").parquet(f"{root}/data")
    data = data.withColumns({"day": F.col("day").cast("string"), "version": F.col("version").cast("bigint")})
    # Partition columns meet the small commit table, so files of other versions are not opened.
    return data.join(F.broadcast(_pointers(spark, root, version)), ["day", "version"], "left_semi").drop("day", "version")


def _write(rows: DataFrame, root: str, version: int) -> None:
    (rows.withColumns({"day": _day(), "version": F.lit(version)}).repartition("day")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "version").parquet(f"{root}/data"))


def _commit(pointers: DataFrame, root: str, version: int) -> None:
    pointers.coalesce(1).write.mode("overwrite").parquet(f"{root}/versions/{version}")


def create(rows: DataFrame, root: str) -> None:
    """Version -1: the table as it begins."""
    _write(rows, root, -1)
    _commit(rows.select(_day().alias("day"), F.lit(-1).cast("bigint").alias("version")).distinct(), root, -1)


def upsert(updates: DataFrame, root: str, version: int, base_path: str | None = None) -> None:
    """Commits ``version``: rows of ``updates`` replace those of the same match, only their days are written.

    A version that is committed already is left as it is. Updates that lose against another one of their key are written to
    ``rejects/version``.
    """
    spark = updates.sparkSession
    if latest(spark, root) is None:
        create(spark.read.parquet(base_path), root)
    before = [v for v in _committed(spark, root) if v < version]
    if version in _committed(spark, root):
        return
    pointers = _pointers(spark, root, before[-1])
    best = [F.desc("seq")] if "seq" in updates.columns else []
    order = [*best, *[F.desc(c) for c in updates.columns if c not in MATCH_KEY]]
    ranked = updates.withColumn("_place", F.row_number().over(W.partitionBy(*MATCH_KEY).orderBy(*order)))
    ranked.where("_place > 1").drop("_place").write.mode("overwrite").parquet(f"{root}/rejects/{version}")
    winners = ranked.where("_place = 1").drop("_place", "seq")
    touched = winners.select(_day().alias("day")).distinct()
    table = read(spark, root, before[-1])
    old = table.withColumn("_day", _day()).join(touched.withColumnRenamed("day", "_day"), "_day", "left_semi").drop("_day")
    _write(upsert_results(old, winners), root, version)
    # A batch touches few days next to the table; both lists are one row per day.
    new = touched.withColumn("version", F.lit(version).cast("bigint"))
    _commit(pointers.join(touched, "day", "left_anti").unionByName(new), root, version)


def drop_before(spark: SparkSession, root: str, version: int) -> list[str]:
    """Removes commits before ``version`` and the files that no later commit names; returns the removed day folders."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    kept = [v for v in _committed(spark, root) if v >= version]
    if not kept:
        raise ValueError(f"version {version} is not committed under {root}")
    used = {(r.day, r.version) for v in kept for r in _pointers(spark, root, v).collect()}
    fs = path(root).getFileSystem(conf)
    gone = []
    for day in fs.listStatus(path(f"{root}/data")):
        if not day.isDirectory():
            continue
        for part in fs.listStatus(day.getPath()):
            name = (day.getPath().getName().removeprefix("day="), int(part.getPath().getName().removeprefix("version=")))
            if name not in used and name[1] < kept[0]:
                fs.delete(part.getPath(), True)
                gone.append(f"{name[0]}/{name[1]}")
    for v in _committed(spark, root):
        if v < kept[0]:
            fs.delete(path(f"{root}/versions/{v}"), True)
    return sorted(gone)
