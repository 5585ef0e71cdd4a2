"""File readers and unions of per-file sources."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from touchline.functions.numbers import to_number
from touchline.operators.scan import keep_one


def _scan(spark: SparkSession, paths: Sequence[str], schema: str | None, encoding: str | None) -> DataFrame:
    """The rows with ``_file``, their file's path."""
    # Latin-1 turns every byte into a sign and loses none, and the signs that part CSV fields are the same in UTF-8.
    reader = spark.read.option("header", True).option("encoding", encoding or "ISO-8859-1").option("enforceSchema", False)
    df = (reader.schema(schema) if schema else reader).csv(list(paths))
    rows = df.select(*[F.col(f"`{c}`").alias(c.lstrip("\ufeff")) for c in df.columns], F.col("_metadata.file_path").alias("_file"))
    if encoding:
        return rows
    utf8 = spark.read.text(list(paths)).groupBy(F.col("_metadata.file_path").alias("_path")).agg(
        F.bool_and(F.is_valid_utf8("value")).alias("_utf8"))
    # One row per file, as many as the driver lists to read them.
    marked = rows.join(F.broadcast(utf8), F.col("_file") == F.col("_path"), "left")
    texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, StringType) and f.name != "_file"]
    return marked.withColumns({
        c: F.when(F.col("_utf8"), F.decode(F.encode(f"`{c}`", "ISO-8859-1"), "UTF-8")).otherwise(F.col(f"`{c}`")) for c in texts
    }).select(*rows.columns)


def scan_csv(spark: SparkSession, paths: str | Sequence[str], schema: str | None = None, encoding: str | None = None) -> DataFrame:
    """Headered CSV; a byte-order mark is ignored.

    Without an ``encoding`` each file has its own: UTF-8 if all of its bytes are, else Latin-1. That is decided by a count
    over the files' lines inside the same plan, so files are split among tasks and the driver reads none of them.
    """
    return _scan(spark, [paths] if isinstance(paths, str) else paths, schema, encoding).drop("_file")


def scan_csv_files(spark: SparkSession, paths: Sequence[str], schema: str, encoding: str | None = None) -> DataFrame:
    """Several files as one scan, with the name of the file each row came from."""
    return _scan(spark, paths, schema, encoding).withColumn("source_file", F.element_at(F.split("_file", "/"), -1)).drop("_file")


def union_sources(sources: dict[str, DataFrame], keys: Sequence[str], seq: str, map_team: Callable[[str], Column],
                  label: str = "source_file", year: dict[str, int] | None = None) -> DataFrame:
    """Union of match files: ``label`` names the file, the first row per key counts, team names are
    mapped with the originals kept, unscored rows go. ``year`` adds each file's year."""
    parts = []
    for number, (name, df) in enumerate(sources.items()):
        df = df.withColumns({label: F.lit(name), "_file": F.lit(number)})
        parts.append(df.withColumn("worldcup_year", F.lit(year[name])) if year else df)
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    out = keep_one(rows, [*(["worldcup_year"] if year else []), *keys], ["_file", seq]).drop("_file")
    out = out.withColumns({"home_team_original": F.col("home_team"), "away_team_original": F.col("away_team")})
    return out.withColumns({
        "home_team": map_team("home_team"), "away_team": map_team("away_team"),
        "home_score": to_number("home_score"), "away_score": to_number("away_score"),
    }).dropna(subset=["home_score", "away_score", "home_team", "away_team"])


def keyed_rows(facts: DataFrame, key_sets: dict[str, DataFrame]) -> DataFrame:
    """Rows of a large table whose keys are all in the given sets (one semi-join per key)."""
    return reduce(
        lambda df, item: df.join(item[1].select(item[0]).distinct(), item[0], "left_semi"), key_sets.items(), facts)
