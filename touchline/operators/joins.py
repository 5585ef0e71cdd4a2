"""Key joins that enrich, overlay and merge match rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.scan import keep_one

MATCH_KEY = ["date", "home_team", "away_team"]


def exact_join(matches: DataFrame, extra: DataFrame, columns: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Left join on the match key; the first ``extra`` row per key counts."""
    have = [c for c in columns if c in extra.columns]
    order = [c for c in seq if c not in MATCH_KEY]
    first = keep_one(extra.select(*MATCH_KEY, *have, *order), MATCH_KEY, order)
    return matches.join(first.drop(*order), MATCH_KEY, "left")


def tolerant_date_join(matches: DataFrame, extra: DataFrame, columns: Sequence[str], seq: str,
                       date_columns: Sequence[str] = ("date", "shanghai_date"), drop_empty: bool = False) -> DataFrame:
    """Left join on teams and a date that may be one day off.

    Each date column makes one pass; the nearest day wins inside a pass, an earlier pass wins per
    column, so one row may take columns from different passes. Of the rows of a key and day only the first can win, so that
    one alone is listed under the days around. ``drop_empty`` leaves out the columns that no match received,
    for which it runs the join once more to count.
    """
    out, filled = matches, {c: [] for c in columns}
    for number, date_column in enumerate(d for d in date_columns if d in extra.columns):
        offsets = F.array(*[F.struct(F.lit(d).alias("days"), F.lit(rank).alias("rank"))
                            for rank, d in enumerate((0, -1, 1))])
        own = extra.select(F.col(date_column).cast("date").alias("date"), "home_team", "away_team", *columns, seq).dropna(subset=MATCH_KEY)
        spread = keep_one(own, MATCH_KEY, [seq]).drop(seq).withColumn("_o", F.explode(offsets)).select(
            F.expr("date_add(date, _o.days)").alias("date"), "home_team", "away_team", *columns, F.col("_o.rank").alias("_rank"))
        nearest = keep_one(spread.where("date is not null"), MATCH_KEY, ["_rank"])
        renamed = {c: f"_{number}_{c}" for c in columns}
        out = out.join(nearest.select(*MATCH_KEY, *[F.col(c).alias(n) for c, n in renamed.items()]), MATCH_KEY, "left")
        for c, n in renamed.items():
            filled[c].append(n)
    out = out.select(*matches.columns, *[F.coalesce(*names).alias(c) for c, names in filled.items()])
    if drop_empty:
        counts = out.agg(*[F.count(c).alias(c) for c in columns]).first()
        out = out.drop(*[c for c in columns if counts[c] == 0])
    return out


def score_overlay(fixtures: DataFrame, completed: DataFrame, seq: str) -> DataFrame:
    """Final scores written over the fixtures' own; a result listed the other way round counts too."""
    both = completed.dropna(subset=[*MATCH_KEY, "home_score", "away_score"]).select(
        "date", seq,
        F.inline(F.array(
            F.struct("home_team", "away_team", F.col("home_score").alias("hs"), F.col("away_score").alias("as_")),
            F.struct(F.col("away_team").alias("home_team"), F.col("home_team").alias("away_team"),
                     F.col("away_score").alias("hs"), F.col("home_score").alias("as_")),
        )),
    )
    latest = keep_one(both, MATCH_KEY, [seq], "last").drop(seq)
    return (
        fixtures.join(latest, MATCH_KEY, "left")
        .withColumns({"home_score": F.coalesce("hs", "home_score"), "away_score": F.coalesce("as_", "away_score")})
        .select(*fixtures.columns)
    )


def upsert_results(base: DataFrame, updates: DataFrame, tournament: str = "FIFA World Cup") -> DataFrame:
    """Finished matches replace base rows of the same key; a key listed twice in ``updates`` is an error."""
    repeated = updates.groupBy(*MATCH_KEY).count().where("count > 1").take(5)
    if repeated:
        raise ValueError(f"keep one row per finished match: {[tuple(r)[:3] for r in repeated]}")
    for column, default in {"tournament": F.lit(tournament), "neutral": F.lit("TRUE")}.items():
        value = F.coalesce(F.col(column), default) if column in updates.columns else default
        updates = updates.withColumn(column, value)
    kept = base.join(updates.select(*MATCH_KEY), MATCH_KEY, "left_anti")
    return kept.unionByName(updates, allowMissingColumns=True)


def uncached(matches: DataFrame, cache: DataFrame, limit: int | None = None, first_day: str | None = None,
             last_day: str | None = None, tournament_contains: str | None = None) -> DataFrame:
    """Matches whose (date, home, away) is not cached yet, case-insensitive, the first ``limit`` by date."""
    out = matches.dropna(subset=MATCH_KEY)
    if first_day:
        out = out.where(F.col("date") >= F.lit(first_day).cast("date"))
    if last_day:
        out = out.where(F.col("date") <= F.lit(last_day).cast("date"))
    if tournament_contains:
        out = out.where(F.lower("tournament").contains(tournament_contains.lower()))
    keyed = lambda d: d.withColumns({"_home": F.lower("home_team"), "_away": F.lower("away_team")})
    seen = keyed(cache).select("date", "_home", "_away")
    out = keyed(out).join(seen, ["date", "_home", "_away"], "left_anti").drop("_home", "_away")
    return out.orderBy("date", "match_id").limit(limit) if limit else out


def missing_keys(fixtures: DataFrame, features: DataFrame, first_day: str, horizon_days: int,
                 feature_date: str = "shanghai_date") -> DataFrame:
    """Fixture keys inside the horizon that no feature row covers within one day."""
    start = F.lit(first_day).cast("date")
    wanted = fixtures.where(F.col("date").between(start, F.date_add(start, horizon_days))).select(
        "date", F.lower(F.trim("home_team")).alias("home"), F.lower(F.trim("away_team")).alias("away")
    ).distinct()
    have = features.select(
        F.explode(F.array(*[F.date_add(feature_date, d) for d in (-1, 0, 1)])).alias("date"),
        F.lower(F.trim("home_team")).alias("home"), F.lower(F.trim("away_team")).alias("away"),
    )
    return wanted.join(have, ["date", "home", "away"], "left_anti")


def covered_matches(matches: DataFrame, squads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches with both teams in ``squads``, and the (side, team) names that are missing."""
    teams = squads.select(F.col("team_name").alias("team")).distinct()
    covered = matches
    for side in ("home_team", "away_team"):
        covered = covered.join(teams.withColumnRenamed("team", side), side, "left_semi")
    sides = matches.select(F.inline(F.array(
        F.struct(F.lit("home").alias("side"), F.col("home_team").alias("team")),
        F.struct(F.lit("away").alias("side"), F.col("away_team").alias("team")),
    ))).where("team is not null").distinct()
    return covered, sides.join(teams, "team", "left_anti")
