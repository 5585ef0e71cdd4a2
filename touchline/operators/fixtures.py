"""Fixture lists: schedule metadata, lookups, open matches and live odds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.aliases import ALIASES, canonical_team, lookup
from touchline.operators.dispersion import pivot_first, score_implied
from touchline.operators.joins import MATCH_KEY
from touchline.operators.scan import keep_one


def _variants(df: DataFrame, swapped: dict[str, str], days: tuple[int, ...]) -> DataFrame:
    """Every row as listed and with its sides swapped, on each shifted day; ``_rank`` is the order of trust."""
    other = {**swapped, **{v: k for k, v in swapped.items()}}
    straight = [F.col(c) for c in df.columns]
    turned = [F.col(other.get(c, c)).alias(c) for c in df.columns]
    both = df.select(*straight, F.lit(0).alias("swapped")).unionByName(df.select(*turned, F.lit(1).alias("swapped")))
    shifts = F.array(*[F.struct(F.lit(d).alias("days"), F.lit(i).alias("i")) for i, d in enumerate(days)])
    return both.select("*", F.explode(shifts).alias("_s")).withColumns({
        "date": F.expr("date_add(date, _s.days)"), "_rank": F.col("_s.i") * 2 + F.col("swapped")}).drop("_s")


#: Columns of the stadium table and what they are called beside a fixture.
STADIUM = {"name_en": "name", "fifa_name": "fifa_name", "city_en": "city", "country_en": "country", "capacity": "capacity", "region": "region"}


def schedule_metadata(fixtures: DataFrame, games: DataFrame, teams: DataFrame, stadia: DataFrame) -> DataFrame:
    """Group, matchday, kind, kickoff (local and UTC) and stadium of each fixture; sides may be swapped or the day one early.

    ``games``: id, home_team_id, away_team_id, group, matchday, type, local_date, date (UTC), stadium_id. ``stadia``: id, name_en,
    fifa_name, city_en, country_en, capacity, region.
    """
    def side(name: str) -> DataFrame:
        return teams.select(F.col("id").alias(f"{name}_team_id"),
                            lookup(canonical_team("name_en"), ALIASES["schedule"]).alias(f"{name}_team"),
                            F.col("fifa_code").alias(f"{name}_fifa_code"))

    rows = games.join(side("home"), "home_team_id", "left").join(side("away"), "away_team_id", "left")
    rows = rows.withColumns({
        "local_kickoff": F.try_to_timestamp("local_date", F.lit("MM/dd/yyyy HH:mm")), "utc_kickoff": F.try_to_timestamp("date")})
    place = stadia.select(F.col("id").alias("stadium_id"), *[F.col(c).alias(f"stadium_{n}") for c, n in STADIUM.items()])
    rows = rows.join(place, "stadium_id", "left")
    host = lambda s: F.coalesce((F.col(f"{s}_team") == F.col("stadium_country")).cast("int"), F.lit(0))
    rows = rows.select(
        F.col("local_kickoff").cast("date").alias("date"), "home_team", "away_team", F.col("id").alias("repo_match_id"),
        F.col("group").alias("worldcup_group"), F.col("matchday").alias("worldcup_matchday"), F.col("type").alias("worldcup_match_type"),
        "local_kickoff", "utc_kickoff", F.hour("local_kickoff").alias("kickoff_hour_local"), "home_fifa_code", "away_fifa_code",
        "stadium_id", *[f"stadium_{n}" for n in STADIUM.values()],
        host("home").alias("is_home_host_country"), host("away").alias("is_away_host_country"))
    rows = rows.withColumn("is_host_country_match", F.greatest("is_home_host_country", "is_away_host_country"))
    pairs = {"home_team": "away_team", "home_fifa_code": "away_fifa_code", "is_home_host_country": "is_away_host_country"}
    found = keep_one(_variants(rows, pairs, (0, -1)), MATCH_KEY, ["_rank", "repo_match_id"]).drop("_rank")
    return fixtures.join(found.withColumnRenamed("swapped", "repo_home_away_swapped"), MATCH_KEY, "left")


def fixture_lookup(requests: DataFrame, fixtures: DataFrame, seq: str) -> DataFrame:
    """Each requested (date, home, away) resolved on that day or the day before, in the listed
    orientation first, else swapped; the first table row counts."""
    table = _variants(fixtures.select("date", "home_team", "away_team", seq), {"home_team": "away_team"}, (0, 1))
    first = keep_one(table, MATCH_KEY, ["swapped", seq]).drop("_rank")
    return requests.join(first, MATCH_KEY, "left").withColumn("available", F.col(seq).isNotNull())


def day_fixtures(fixtures: DataFrame) -> DataFrame:
    """Fixtures per viewing day: those of the day before when there are any, else the day's own."""
    early = fixtures.withColumn("day", F.date_add("date", 1))
    taken = early.select("day").distinct()
    own = fixtures.withColumn("day", F.col("date")).join(taken, "day", "left_anti")
    return early.unionByName(own)


def unlisted_fixtures(fixtures: DataFrame, listed: DataFrame) -> DataFrame:
    """Fixtures of each viewing day that are not listed for that day in either orientation."""
    low = lambda c: F.lower(c)
    pair = lambda d: d.withColumns({
        "_p": F.least(low("home_team"), low("away_team")), "_q": F.greatest(low("home_team"), low("away_team"))})
    seen = pair(listed).select("day", "_p", "_q")
    return pair(day_fixtures(fixtures)).join(seen, ["day", "_p", "_q"], "left_anti").drop("_p", "_q")


def open_match_count(fixtures: DataFrame, listed: DataFrame, horizon: int = 14) -> DataFrame:
    """Per viewing day: open matches on sale, scheduled fixtures, next day with fixtures."""
    scheduled = day_fixtures(fixtures).groupBy("day").agg(F.count("*").alias("scheduled"))
    opened = listed.groupBy("day").agg(F.count_distinct("match_id", "home_team", "away_team").alias("open"))
    days = scheduled.join(opened, "day", "left").fillna(0, subset=["open"])
    # One row per calendar day, so one task orders a few thousand rows at most.
    following = F.lead("day").over(W.orderBy("day"))
    return days.withColumn("_next", following).withColumn(
        "next_day", F.when(F.datediff("_next", "day") <= horizon, F.col("_next")).otherwise(F.col("day"))).drop("_next")


CLOSING = ["closing_home_odds", "closing_draw_odds", "closing_away_odds"]


def live_odds_overlay(fixtures: DataFrame, had: DataFrame, scores: DataFrame, seq: str) -> DataFrame:
    """Live 1X2 prices, else prices implied by exact scores, over the existing closing odds.

    Lottery days may be one ahead of the local day: both are tried, the same day first.
    """
    outcomes = dict(zip(("home_win", "draw", "away_win"), CLOSING))
    listed = pivot_first(had, MATCH_KEY, seq, outcomes).withColumns({"_label": F.lit("live_sporttery_had"), "_source": F.lit(0)})
    derived = score_implied(scores, MATCH_KEY).select(
        *MATCH_KEY, *[F.when(F.col(f"{s}_prob") > 0, 1 / F.col(f"{s}_prob")).alias(c) for s, c in zip(("home", "draw", "away"), CLOSING)],
        F.lit("live_sporttery_crs_implied").alias("_label"), F.lit(1).alias("_source"))
    spread = listed.unionByName(derived).select(
        "*", F.explode(F.array(F.lit(0), F.lit(-1))).alias("_shift")).withColumns({
            "date": F.expr("date_add(date, _shift)"), "_late": -F.col("_shift")}).drop("_shift")
    live = keep_one(spread, MATCH_KEY, ["_late", "_source"]).drop("_late", "_source")
    live = live.withColumnsRenamed({c: f"live_{c}" for c in CLOSING})
    out = fixtures.join(live, MATCH_KEY, "left")
    full = lambda prefix: _all([F.col(f"{prefix}{c}").isNotNull() for c in CLOSING])
    merged = {c: F.coalesce(F.col(f"live_{c}"), F.col(c)) if c in fixtures.columns else F.col(f"live_{c}") for c in CLOSING}
    out = out.withColumn("_live", full("live_")).withColumns(merged)
    source = F.when(F.col("_live"), F.coalesce("_label", F.lit("live_sporttery"))).when(full(""), "historical_or_existing").otherwise("missing")
    return out.withColumn("odds_source", source).drop("_live", "_label", *[f"live_{c}" for c in CLOSING])


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out
