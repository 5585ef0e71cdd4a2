"""Ordered computations that do not depend on how rows spread over keys.

A window over one hot key (or over no key at all) runs in one task. The operators here either
shrink the input with a map-side aggregate first, or cut the global sort order into the sort's own
balanced partitions and carry small per-partition totals from one to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.session import cut_lineage


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "first") -> DataFrame:
    """One whole row per key: the first or last in ``order``. Partial results merge map-side."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if keep == "first" else F.max_by
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def _positions(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Globally sorted rows with ``_part`` (sort partition) and ``_idx`` (0-based row in it).

    The sort's range partitions are balanced by sampling, whatever the keys look like. The rows are
    written out, because a recomputed sort may cut the ranges elsewhere.
    """
    placed = df.orderBy(*order).withColumn("_pos", F.monotonically_increasing_id())
    return cut_lineage(placed).withColumns(
        {"_part": F.shiftrightunsigned("_pos", 33), "_idx": F.col("_pos").bitwiseAND((1 << 33) - 1)}
    ).drop("_pos")


def rank_all(df: DataFrame, order: Sequence[Column | str], rank: str = "rank", size: str = "row_count") -> DataFrame:
    """1-based position of every row in the global ``order``, and the number of rows."""
    placed = _positions(df, order)
    # One row per sort partition, so the unpartitioned window sees a few thousand rows at most.
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    parts = parts.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"), F.sum("_n").over(whole).alias(size)
    )
    return (
        placed.join(F.broadcast(parts), "_part")
        .withColumn(rank, F.col("_skip") + F.col("_idx") + 1)
        .drop("_part", "_idx", "_skip")
    )


def rank_within(df: DataFrame, by: Sequence[str], order: Sequence[Column | str],
                rank: str = "rank", size: str = "row_count") -> DataFrame:
    """1-based position inside each group and the group's size; a group may hold any share of rows."""
    placed = rank_all(df, [*by, *order], "_all", "_size")
    groups = placed.groupBy(*by).agg(F.min("_all").alias("_first"), F.count("*").alias(size))
    return (
        placed.join(groups, list(by))
        .withColumn(rank, F.col("_all") - F.col("_first") + 1)
        .drop("_all", "_size", "_first")
    )


def previous_row(df: DataFrame, by: Sequence[str], order: Sequence[str], bucket: Column,
                 payload: Sequence[str], prefix: str = "previous_") -> DataFrame:
    """``lag`` of ``payload`` per key. ``bucket`` must rise with ``order``; it bounds each window.

    Rows are windowed inside (key, bucket); the first row of a bucket gets the last row of the key's
    previous non-empty bucket, found on one summary row per (key, bucket).
    """
    part = [*by, "_bucket"]
    rows = df.withColumn("_bucket", bucket)
    here = F.struct(*payload)
    inner = W.partitionBy(*part).orderBy(*order)
    ends = rows.groupBy(*part).agg(F.max_by(here, F.struct(*order)).alias("_end"))
    carry = ends.select(*part, F.lag("_end").over(W.partitionBy(*by).orderBy("_bucket")).alias("_carry"))
    return (
        rows.withColumn("_lag", F.lag(here).over(inner))
        .join(carry, part, "left")
        .withColumn("_prev", F.coalesce("_lag", "_carry"))
        .select(*df.columns, *[F.col(f"_prev.{c}").alias(f"{prefix}{c}") for c in payload])
    )


def running_within(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], value: str, out: str) -> DataFrame:
    """Running sum of ``value`` inside each group in ``order``; a group may hold any share of rows.

    Windows run per (group, sort partition); the sums of earlier partitions are carried in.
    """
    placed = _positions(df, [*by, *order])
    part = [*by, "_part"]
    totals = placed.groupBy(*part).agg(F.sum(value).alias("_n"))
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(*part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_carry"))
    here = W.partitionBy(*part).orderBy("_idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        placed.withColumn("_sum", F.sum(value).over(here)).join(carry, part)
        .withColumn(out, F.col("_sum") + F.col("_carry")).drop("_part", "_idx", "_sum", "_carry")
    )
