"""Queries over match history: cleaning, as-of features, form, head-to-head, standings, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.dates import parse_mixed_dates
from touchline.functions.numbers import to_number
from touchline.operators import form, joins, matchclean, ratings, scan, splits, standings
from touchline.operators.asof import as_of_sides
from touchline.operators.events import STATS, event_team_stats
from touchline.operators.headtohead import H2H_COLUMNS, head_to_head
from touchline.plans import carriers as c
from touchline.plans.common import r6, show
from touchline.sources.tables import table


def rename_map(spark: SparkSession, folder: str) -> DataFrame:
    out = matchclean.standard_names(c.raw_matches(spark, folder))
    return show(out, ["match_id", "date", "home_team", "away_team", "home_score", "away_score"], ["closing_home_odds"])


def parse_dates(spark: SparkSession, folder: str) -> DataFrame:
    return c.text_dates(spark, folder).select(
        "o_orderkey", "text", parse_mixed_dates("text").cast("string").alias("day"))


def coerce_numeric(spark: SparkSession, folder: str) -> DataFrame:
    text = F.expr("""case o_orderkey % 6 when 0 then cast(cast(o_totalprice as decimal(18, 2)) as string)
        when 1 then '' when 2 then ' 12.5 ' when 3 then 'NaN' when 4 then '7d' else 'abc' end""")
    return table(spark, folder, "orders").select("o_orderkey", r6(to_number(text), "number"))


def result_label(spark: SparkSession, folder: str) -> DataFrame:
    return c.matches(spark, folder).select("match_id", matchclean.result_label().alias("result"))


def clean_matches(spark: SparkSession, folder: str) -> DataFrame:
    out = matchclean.clean_matches(c.raw_matches(spark, folder))
    return show(out, ["match_id", "date", "home_team", "away_team", "result"],
                ["home_score", "away_score", "closing_home_odds"])


def raw_ratings(spark: SparkSession, folder: str) -> DataFrame:
    return c.text_dates(spark, folder).join(table(spark, folder, "orders"), "o_orderkey").selectExpr(
        "o_orderkey as seq", "concat(' T', o_custkey % 100, ' ') as team", "text as date",
        "case when o_orderkey % 7 = 0 then '-' else cast(cast(o_totalprice as decimal(18, 2)) as string) end as elo")


def clean_ratings(spark: SparkSession, folder: str) -> DataFrame:
    return show(ratings.clean_ratings(raw_ratings(spark, folder)), ["seq", "team", "date"], ["elo"])


def match_flags(spark: SparkSession, folder: str) -> DataFrame:
    return matchclean.match_flags(c.matches(spark, folder)).select(
        "match_id", "is_neutral", "is_world_cup", "is_friendly")


def recency_filter(spark: SparkSession, folder: str) -> DataFrame:
    return show(matchclean.latest_years(c.matches(spark, folder), 4), ["match_id", "date"], [])


def both_sides_allowed(spark: SparkSession, folder: str) -> DataFrame:
    teams = c.static_ratings(spark, folder).where("elo > 2000")
    out = matchclean.both_sides_allowed(c.matches(spark, folder), teams)
    return show(out, ["match_id", "date", "home_team", "away_team"], [])


def static_lookup(spark: SparkSession, folder: str) -> DataFrame:
    out = ratings.static_elo(c.matches(spark, folder), c.static_ratings(spark, folder))
    return show(out, ["match_id"], ["home_elo", "away_elo"])


def asof_elo(spark: SparkSession, folder: str) -> DataFrame:
    out = ratings.dated_elo(c.matches(spark, folder), c.ratings(spark, folder))
    return show(out, ["match_id"], ["home_elo", "away_elo"])


def elo_features(spark: SparkSession, folder: str) -> DataFrame:
    out = ratings.elo_features(c.matches(spark, folder), c.ratings(spark, folder))
    return show(out, ["match_id"], ["elo_diff", "elo_abs_diff", "elo_ratio"])


RANKING = ["home_fifa_rank", "away_fifa_rank", "home_fifa_points", "away_fifa_points", "fifa_rank_diff", "fifa_points_diff"]


def asof_ranking(spark: SparkSession, folder: str) -> DataFrame:
    out = ratings.ranking_features(c.matches(spark, folder), c.rankings(spark, folder))
    return show(out, ["match_id"], RANKING)


def asof_inclusive_latest(spark: SparkSession, folder: str) -> DataFrame:
    upper = c.matches(spark, folder).withColumns({s: F.upper(s) for s in ("home_team", "away_team")})
    lower = c.ratings(spark, folder).withColumn("team", F.upper(F.lower("team")))
    out = ratings.dated_elo(upper, lower, strict=False)
    return show(out, ["match_id"], ["home_elo", "away_elo"])


def event_matches(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "event_id", "to_date(ts) as date", "concat('T', user_id % 100) as home_team",
        "concat('T', get_json_object(props, '$.k')) as away_team")


def event_stats(spark: SparkSession, folder: str) -> DataFrame:
    events = c.team_events(spark, folder)
    sides = events.groupBy("match_id", "date").agg(
        F.concat(F.lit("T"), F.count("*") % 100).alias("home_team"), F.min("team").alias("away_team"))
    return event_team_stats(sides, events)


def event_team(spark: SparkSession, folder: str) -> DataFrame:
    return show(event_stats(spark, folder), ["match_id", "team"], STATS)


def team_day_stats(spark: SparkSession, folder: str) -> DataFrame:
    events = c.team_events(spark, folder)
    return event_team_stats(events.select("match_id", "date", "team").distinct(), events)


def expanding_prior(spark: SparkSession, folder: str) -> DataFrame:
    out = form.running_means(team_day_stats(spark, folder), STATS, "match_id")
    return show(out, ["team", "date"], ["prior_matches", *[f"{s}_prior_mean" for s in STATS]])


def asof_event_prior(spark: SparkSession, folder: str) -> DataFrame:
    prior = form.running_means(team_day_stats(spark, folder), STATS, "match_id")
    columns = ["prior_matches", *[f"{s}_prior_mean" for s in STATS]]
    out = as_of_sides(event_matches(spark, folder), prior, columns, ["match_id"])
    out = form.with_differences(out, columns)
    return show(out, ["event_id"], [f"{p}{s}" for s in columns[:4] for p in ("home_", "away_")] + [f"{s}_diff" for s in columns])


def recent_form(spark: SparkSession, folder: str) -> DataFrame:
    out = form.recent_form(c.matches(spark, folder))
    names = form.form_columns()
    return show(out, ["match_id"], [f"home_{n}" for n in names] + [f"away_{n}" for n in names] + [f"{n}_diff" for n in names])


def team_history(spark: SparkSession, folder: str) -> DataFrame:
    out = form.team_history(c.matches(spark, folder))
    return show(out, ["match_id", "date", "team"], ["goals_for", "goals_against", "goal_diff"], ["win", "draw", "points"])


def h2h(spark: SparkSession, folder: str) -> DataFrame:
    return show(head_to_head(c.matches(spark, folder)), ["match_id"], H2H_COLUMNS)


def standings_before(spark: SparkSession, folder: str) -> DataFrame:
    out = standings.standings_before(c.fixtures(spark, folder))
    return show(out, ["fixture_id"], [m for m in standings.MOTIVATION if "pressure" not in m and "flag" not in m and "chase" not in m])


def group_pressure(spark: SparkSession, folder: str) -> DataFrame:
    out = standings.standings_before(c.fixtures(spark, folder))
    return show(out, ["fixture_id"], [m for m in standings.MOTIVATION if "pressure" in m or "flag" in m or "chase" in m])


def raw_completed(spark: SparkSession, folder: str) -> DataFrame:
    """Finished fixtures as a hand-kept file: text values, sides swapped now and then, some blanks."""
    return table(spark, folder, "orders").join(
        c.fixtures(spark, folder).drop("date", "home_score", "away_score"), F.expr("o_orderkey = fixture_id")
    ).selectExpr(
        "fixture_id as seq", "date_format(o_orderdate, 'yyyy-MM-dd') as date",
        "concat(' ', if(fixture_id % 8 = 0, away_team, home_team)) as home_team",
        "if(fixture_id % 8 = 0, home_team, away_team) as away_team",
        "cast(fixture_id % 6 as string) as home_score",
        "case when fixture_id % 20 = 0 then '' else cast(fixture_id % 3 as string) end as away_score",
        "case when fixture_id % 12 = 0 then 'Qualifier' end as tournament")


def clean_completed(spark: SparkSession, folder: str) -> DataFrame:
    out = matchclean.clean_completed(raw_completed(spark, folder))
    return show(out, ["seq", "date", "home_team", "away_team"], ["home_score", "away_score"])


def score_overlay(spark: SparkSession, folder: str) -> DataFrame:
    done = matchclean.clean_completed(raw_completed(spark, folder))
    return show(joins.score_overlay(c.fixtures(spark, folder), done, "seq"), ["fixture_id"], ["home_score", "away_score"])


def upsert_results(spark: SparkSession, folder: str) -> DataFrame:
    done = matchclean.clean_completed(raw_completed(spark, folder))
    updates = scan.keep_one(done, joins.MATCH_KEY, ["seq"], "last").drop("seq")
    base = c.fixtures(spark, folder).select(*joins.MATCH_KEY, "home_score", "away_score", "worldcup_group")
    out = joins.upsert_results(base, updates)
    return show(out, [*joins.MATCH_KEY, "worldcup_group", "tournament", "neutral"], ["home_score", "away_score"])


def union_align(spark: SparkSession, folder: str) -> DataFrame:
    left = c.ratings(spark, folder).select("team", "date", "elo")
    right = c.rankings(spark, folder).select("date", "team", "fifa_rank")
    return show(left.unionByName(right, allowMissingColumns=True), ["team", "date"], ["elo", "fifa_rank"])


def distinct_teams(spark: SparkSession, folder: str) -> DataFrame:
    return c.matches(spark, folder).select(
        F.year("date").alias("year"), F.explode(F.array("home_team", "away_team")).alias("team")).distinct()


def key_difference(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["date", "home_team", "away_team"]
    left, right = c.matches(spark, folder).select(*keys).distinct(), c.closing_odds(spark, folder).select(*keys)
    return show(left.join(right, keys, "left_anti"), keys, [])


ODDS = ["closing_home_odds", "closing_draw_odds", "closing_away_odds"]


def odds_exact_join(spark: SparkSession, folder: str) -> DataFrame:
    out = joins.exact_join(c.matches(spark, folder), c.closing_odds(spark, folder), ODDS, ["seq"])
    return show(out, ["match_id"], ODDS)


# The sentiment columns joined to matches.
SENTIMENT = [f"off_field_{n}" for n in (
    "home_overall", "away_overall", "diff", "confidence", "home_morale", "away_morale", "home_external",
    "away_external", "home_media", "away_media", "home_motivation", "away_motivation")]


def sentiment_join(spark: SparkSession, folder: str) -> DataFrame:
    scores = c.closing_odds(spark, folder).select(
        "date", "home_team", "away_team", "seq",
        *[F.expr(f"floor(closing_home_odds * {i} + closing_draw_odds) % 7 - 3").cast("int").alias(n)
          for i, n in enumerate(SENTIMENT, 1)])
    out = joins.exact_join(c.matches(spark, folder), scores, SENTIMENT, ["seq"])
    return show(out, ["match_id"], [], SENTIMENT)


def tolerant_date_join(spark: SparkSession, folder: str) -> DataFrame:
    out = joins.tolerant_date_join(c.matches(spark, folder), c.closing_odds(spark, folder), ODDS, "seq")
    return show(out, ["match_id"], ODDS)


def squad_join_diff(spark: SparkSession, folder: str) -> DataFrame:
    team = c.ratings(spark, folder).groupBy("team").agg(
        F.count("*").alias("player_count"), F.avg("elo").alias("rating_mean"), F.max("elo").alias("rating_max"))
    out = ratings.squad_differences(c.matches(spark, folder), team)
    return show(out, ["match_id"], ["home_squad_rating_mean", "away_squad_rating_mean", "squad_rating_mean_diff",
                                    "squad_rating_max_diff", "squad_player_count_diff"])


def dedupe_keep(spark: SparkSession, folder: str) -> DataFrame:
    rows = c.ratings(spark, folder)
    first = scan.keep_one(rows, ["team", "date"], ["seq"]).withColumnsRenamed({"elo": "first_elo", "seq": "first_seq"})
    last = scan.keep_one(rows, ["team", "date"], ["seq"], "last").withColumnsRenamed({"elo": "last_elo", "seq": "last_seq"})
    return show(first.join(last, ["team", "date"]), ["team", "date", "first_seq", "last_seq"], ["first_elo", "last_elo"])


def time_split(spark: SparkSession, folder: str) -> DataFrame:
    return splits.time_split(c.matches(spark, folder).select("match_id", "date"), ["date", "match_id"]).select(
        "match_id", "split_80_20", "split_70_10_20")


def sequence_id(spark: SparkSession, folder: str) -> DataFrame:
    rows = c.fixtures(spark, folder).select("fixture_id", "date")
    return scan.rank_all(rows, ["date", "fixture_id"], "sequence").select("fixture_id", "sequence")


def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = c.matches(spark, folder).select("match_id", F.year("date").alias("year"))
    return splits.stratified_split(rows, ["match_id"], ["year"], 0.75, 42)


def value_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return splits.value_distribution(
        c.matches(spark, folder).withColumn("result", matchclean.result_label().cast("string")), ["result", "tournament", "neutral"])


def incremental_uncached(spark: SparkSession, folder: str) -> DataFrame:
    out = joins.uncached(c.matches(spark, folder), c.closing_odds(spark, folder), None, "1996-01-01",
                         tournament_contains="World Cup")
    return show(out, ["match_id", "date"], [])


def key_coverage_missing(spark: SparkSession, folder: str) -> DataFrame:
    out = joins.missing_keys(c.matches(spark, folder), c.closing_odds(spark, folder), "1995-01-01", 3650)
    return show(out, ["date", "home", "away"], [])


def coverage_filter(spark: SparkSession, folder: str) -> DataFrame:
    squads = c.static_ratings(spark, folder).where("elo > 2000").withColumnRenamed("team", "team_name")
    covered, missing = joins.covered_matches(c.matches(spark, folder), squads)
    return covered.select(F.lit("covered").alias("kind"), F.col("match_id").alias("key")).unionByName(
        missing.select(F.concat(F.lit("missing_"), "side").alias("kind"), F.col("team").alias("key")))


QUERIES = {
    "rename_map": rename_map,
    "parse_mixed_dates": parse_dates,
    "coerce_numeric": coerce_numeric,
    "result_label": result_label,
    "clean_matches": clean_matches,
    "clean_ratings": clean_ratings,
    "match_flags": match_flags,
    "recency_filter": recency_filter,
    "both_sides_allowed": both_sides_allowed,
    "static_lookup": static_lookup,
    "asof_elo": asof_elo,
    "elo_features": elo_features,
    "asof_ranking": asof_ranking,
    "asof_inclusive_latest": asof_inclusive_latest,
    "event_team_stats": event_team,
    "expanding_prior": expanding_prior,
    "asof_event_prior": asof_event_prior,
    "recent_form": recent_form,
    "team_history": team_history,
    "h2h": h2h,
    "standings_before": standings_before,
    "group_pressure": group_pressure,
    "clean_completed": clean_completed,
    "score_overlay": score_overlay,
    "upsert_results": upsert_results,
    "union_align": union_align,
    "distinct_teams": distinct_teams,
    "key_difference": key_difference,
    "odds_exact_join": odds_exact_join,
    "sentiment_join": sentiment_join,
    "tolerant_date_join": tolerant_date_join,
    "squad_join_diff": squad_join_diff,
    "dedupe_keep": dedupe_keep,
    "time_split": time_split,
    "sequence_id": sequence_id,
    "stratified_split": stratified_split,
    "value_distribution": value_distribution,
    "incremental_uncached": incremental_uncached,
    "key_coverage_missing": key_coverage_missing,
    "coverage_filter": coverage_filter,
}


def minimum_slice(spark: SparkSession, folder: str) -> DataFrame:
    """Both teams' trailing form and latest rating strictly before every match, with differences."""
    rated = ratings.elo_features(c.matches(spark, folder), c.ratings(spark, folder))
    names = form.form_columns()
    out = form.recent_form(rated)
    return show(out, ["match_id", "date", "home_team", "away_team"],
                ["home_elo", "away_elo", "elo_diff", "elo_ratio", *[f"{n}_diff" for n in names]])


