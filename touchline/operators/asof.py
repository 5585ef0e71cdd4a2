"""As-of lookups: the latest known row before (or at) a moment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(probes: DataFrame, state: DataFrame, by: Sequence[str], at: str, payload: Sequence[str],
          seq: Sequence[str] = (), strict: bool = True, bucket: Column | None = None) -> DataFrame:
    """One row per distinct ``(by, at)`` of ``probes`` with the latest ``payload`` of ``state``.

    ``strict`` sees only rows before the moment. Rows of one key and moment are settled by ``seq``
    (highest wins; a single column must tell them apart). The latest *row* is found: its null values stay null.

    State is first reduced to one row per (key, moment) and probes to distinct moments, both
    map-side. With day moments that bounds every window by the calendar. For finer clocks pass
    ``bucket``, an expression of ``at`` that rises with it: windows then run per (key, bucket) and
    the last row of earlier buckets is carried in, so a hot key still spreads over many tasks.
    """
    known = state.where(" and ".join(f"`{c}` is not null" for c in [*by, at]))
    asked = probes.where(" and ".join(f"`{c}` is not null" for c in [*by, at])).select(*by, at).distinct()
    if len(seq) == 1:
        # Plain columns keep the sums in a hash table; a struct would make Spark sort all rows first.
        best = known.groupBy(*by, at).agg(*[F.max_by(c, seq[0]).alias(f"_{c}") for c in payload])
        latest = best.select(*by, at, F.struct(*[F.col(f"_{c}").alias(c) for c in payload]).alias("_row"))
    else:
        order = F.struct(*seq) if seq else F.struct(*payload)
        latest = known.groupBy(*by, at).agg(F.max_by(F.struct(*payload), order).alias("_row"))
    # At one moment the probe comes before the state row when strict, after it when not.
    rows = latest.withColumn("_asked", F.lit(False)).unionByName(asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    place = [at, F.col("_asked").desc() if strict else F.col("_asked").asc()]
    if bucket is None:
        window = W.partitionBy(*by).orderBy(*place).rowsBetween(W.unboundedPreceding, W.currentRow)
        found = rows.withColumn("_found", F.last("_row", ignorenulls=True).over(window))
    else:
        part = [*by, "_bucket"]
        rows = rows.withColumn("_bucket", bucket)
        window = W.partitionBy(*part).orderBy(*place).rowsBetween(W.unboundedPreceding, W.currentRow)
        ends = rows.groupBy(*part).agg(
            F.max_by("_row", F.when(F.col("_row").isNotNull(), F.col(at))).alias("_end")
        )
        earlier = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
        carry = ends.select(*part, F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
        found = (
            rows.withColumn("_local", F.last("_row", ignorenulls=True).over(window))
            .join(carry, part, "left")
            .withColumn("_found", F.coalesce("_local", "_carry"))
        )
    return found.where("_asked").select(*by, at, *[F.col(f"_found.{c}").alias(c) for c in payload])


def side_keys(matches: DataFrame, date: str = "date") -> DataFrame:
    """(team, date) of both sides of every match, from one scan."""
    return matches.select(F.explode(F.array("home_team", "away_team")).alias("team"), date)


def attach_sides(matches: DataFrame, features: DataFrame, columns: Sequence[str], date: str = "date", first: str = "home") -> DataFrame:
    """Join per-(team, date) features to both sides as ``home_*`` and ``away_*``.

    ``first`` names the side that is joined first; where the matches' last join was by that side, its rows need not move again.
    """
    out = matches
    for side in ("home", "away") if first == "home" else ("away", "home"):
        out = out.join(
            features.select(
                F.col("team").alias(f"{side}_team"), date,
                *[F.col(c).alias(f"{side}_{c}") for c in columns],
            ),
            [f"{side}_team", date], "left",
        )
    return out


def as_of_sides(matches: DataFrame, state: DataFrame, payload: Sequence[str],
                seq: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """Latest ``payload`` of (team, date) ``state`` before each match, for both teams at once."""
    found = as_of(side_keys(matches), state, ["team"], "date", payload, seq, strict)
    return attach_sides(matches, found, payload)
