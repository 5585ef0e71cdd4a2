"""Bookmaker prices: consensus, disagreement, implied probabilities and picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SIDES = ["home", "draw", "away"]
DISPERSION_COLUMNS = [f"odds_api_{n}" for n in (
    "bookmaker_count", "prob_dispersion_mean", "prob_dispersion_max", "prob_range_mean", "prob_range_max",
    "draw_disagreement_score")] + [
    f"odds_api_{side}_{stat}" for side in SIDES
    for stat in ("odds_mean", "odds_std", "odds_cv", "prob_mean", "prob_std", "prob_range")]


def implied(odds: Column) -> Column:
    return F.when(odds > 1, 1 / odds)


def equivalent_odds(probability: Column) -> Column:
    return F.when(probability > 0, 1 / probability)


def bookmaker_sides(long: DataFrame, event: Sequence[str], seq: str = "seq") -> DataFrame:
    """One row per event and bookmaker with the first price of each side; map-side combined."""
    side = lambda s: F.min_by(
        F.when(F.col("outcome") == s, F.col("odds")), F.when(F.col("outcome") == s, F.col(seq))).alias(s)
    return long.where("odds > 1").groupBy(*event, "bookmaker").agg(*[side(s) for s in SIDES])


def dispersion_features(long: DataFrame, event: Sequence[str], seq: str = "seq") -> DataFrame:
    """How far bookmakers disagree on an event, from complete price sets; population deviations.

    An event key with a null part has no complete price set and drops out.
    """
    wide = bookmaker_sides(long.dropna(subset=list(event)), event, seq).dropna(subset=SIDES)
    total = sum((1 / F.col(s) for s in SIDES), F.lit(0.0))
    wide = wide.withColumns({f"{s}_prob": (1 / F.col(s)) / total for s in SIDES})
    aggregates = [F.count_distinct("bookmaker").cast("double").alias("odds_api_bookmaker_count")]
    for s in SIDES:
        prob = f"{s}_prob"
        aggregates += [
            F.avg(s).alias(f"odds_api_{s}_odds_mean"), F.stddev_pop(s).alias(f"odds_api_{s}_odds_std"),
            F.avg(prob).alias(f"odds_api_{s}_prob_mean"), F.stddev_pop(prob).alias(f"odds_api_{s}_prob_std"),
            (F.max(prob) - F.min(prob)).alias(f"odds_api_{s}_prob_range"),
        ]
    out = wide.groupBy(*event).agg(*aggregates)
    col = lambda s, stat: F.col(f"odds_api_{s}_{stat}")
    out = out.withColumns({
        f"odds_api_{s}_odds_cv": F.when(col(s, "odds_mean") > 0, col(s, "odds_std") / col(s, "odds_mean")).otherwise(0.0)
        for s in SIDES})
    stds, ranges = [col(s, "prob_std") for s in SIDES], [col(s, "prob_range") for s in SIDES]
    return out.withColumns({
        "odds_api_prob_dispersion_mean": (stds[0] + stds[1] + stds[2]) / 3,
        "odds_api_prob_dispersion_max": F.greatest(*stds),
        "odds_api_prob_range_mean": (ranges[0] + ranges[1] + ranges[2]) / 3,
        "odds_api_prob_range_max": F.greatest(*ranges),
        "odds_api_draw_disagreement_score": col("draw", "prob_std") + col("draw", "odds_cv"),
    })


def consensus(wide: DataFrame, event: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean available price per event and the number of bookmakers."""
    return wide.groupBy(*event).agg(
        *[F.avg(c).alias(c) for c in columns], F.count_distinct("bookmaker").alias("bookmaker_count"))


def normalized_probabilities(odds: DataFrame, group: Sequence[str]) -> DataFrame:
    """Implied probability per outcome and its share of the pool (one row per outcome)."""
    raw = F.when(F.col("odds") > 0, 1 / F.col("odds"))
    return odds.withColumns(
        {"implied": implied(F.col("odds")), "probability": raw / F.sum(raw).over(W.partitionBy(*group))})


# Order in which equal outcomes are preferred.
OUTCOME_ORDER = ["home_win", "draw", "away_win"]


def outcome_rank(outcome: Column) -> Column:
    return F.array_position(F.array(*[F.lit(o) for o in OUTCOME_ORDER]), outcome)


def market_pick(odds: DataFrame, group: Sequence[str]) -> DataFrame:
    """Outcome with the highest implied probability (the shortest price) per pool."""
    priced = F.when(F.col("odds") > 0, F.struct(-F.col("odds"), -outcome_rank(F.col("outcome"))))
    return odds.groupBy(*group).agg(F.max_by("outcome", priced).alias("pick"))


def yes_no_signals(rows: DataFrame) -> DataFrame:
    """Markets whose outcomes are exactly Yes and No keep the Yes row, others keep all rows; rows without a market go.

    The rows are read once: a market's outcomes meet in a window, its key comes first in the result.
    """
    yes, no, market = F.col("outcome") == "Yes", F.col("outcome") == "No", W.partitionBy("market_id")
    binary = F.bool_or(yes).over(market) & F.bool_or(no).over(market) & F.bool_and(yes | no).over(market)
    out = rows.where("market_id is not null").withColumn("_binary", binary).where(~F.col("_binary") | yes)
    out = out.select("market_id", *[c for c in rows.columns if c != "market_id"])
    return out.orderBy("signal_type", F.desc_nulls_last("volume"), F.desc_nulls_last("liquidity"))


def score_implied(scores: DataFrame, group: Sequence[str]) -> DataFrame:
    """1X2 probabilities from exact-score odds; catch-all scores do not count."""
    home = F.regexp_extract("outcome", r"^(\d+)-(\d+)$", 1).try_cast("int")
    away = F.regexp_extract("outcome", r"^(\d+)-(\d+)$", 2).try_cast("int")
    raw = F.when(F.col("odds") > 0, 1 / F.col("odds"))
    part = lambda cond: F.coalesce(F.sum(F.when(cond, raw)), F.lit(0.0))
    out = scores.where(home.isNotNull()).groupBy(*group).agg(
        part(home > away).alias("home"), part(home == away).alias("draw"), part(home < away).alias("away"))
    total = F.col("home") + F.col("draw") + F.col("away")
    return out.where(total > 0).select(*group, *[(F.col(s) / total).alias(f"{s}_prob") for s in SIDES])


def pivot_first(odds: DataFrame, group: Sequence[str], seq: str, names: dict[str, str]) -> DataFrame:
    """First price of each named outcome per group, as columns."""
    first = lambda o: F.min_by(
        F.when(F.col("outcome") == o, F.col("odds")), F.when(F.col("outcome") == o, F.col(seq)))
    return odds.dropna(subset=list(group)).groupBy(*group).agg(*[first(o).alias(n) for o, n in names.items()])


def shortest_odds(scores: DataFrame, group: Sequence[str], n: int) -> DataFrame:
    """The ``n`` lowest exact-score prices per group, catch-alls excluded."""
    order = W.partitionBy(*group).orderBy("odds", "outcome")
    named = scores.where(F.col("odds").isNotNull() & ~F.col("outcome").contains("other"))
    return named.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)
