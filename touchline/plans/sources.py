"""Queries over nested payloads, source unions and scalar text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import numbers, text
from touchline.functions.aliases import canonical_team as canonical
from touchline.operators import dispersion
from touchline.operators.scan import keep_one
from touchline.plans import carriers as c
from touchline.plans import payload_text as p
from touchline.plans.common import r6, show
from touchline.sources import flatten, pages, readers
from touchline.sources.tables import table


def payload(spark: SparkSession, folder: str, text_sql: str) -> DataFrame:
    """A payload per part; small files are dealt out, as texts take far more time to make and parse than to shuffle keys."""
    return table(spark, folder, "part").repartition("p_partkey").selectExpr("p_partkey", f"{text_sql} as payload")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return flatten.parse_payload(payload(spark, folder, p.BOOKMAKER), flatten.BOOKMAKER_SCHEMA)


def flatten_bookmaker_long(spark: SparkSession, folder: str) -> DataFrame:
    out = flatten.bookmaker_long(events(spark, folder))
    return show(out, ["event_id", "date", "shanghai_date", "home_team", "away_team", "bookmaker_key", "outcome_key",
                      "outcome_name"], ["odds"])


WIDE = ["closing_home_odds", "closing_draw_odds", "closing_away_odds", "closing_handicap_line",
        "closing_home_handicap_odds", "closing_away_handicap_line", "closing_away_handicap_odds",
        "closing_over_under_line", "closing_over_odds", "closing_under_odds"]


def flatten_bookmaker_wide(spark: SparkSession, folder: str) -> DataFrame:
    return show(flatten.bookmaker_wide(events(spark, folder)), ["event_id", "bookmaker", "home_team", "away_team"], WIDE)


def odds_consensus(spark: SparkSession, folder: str) -> DataFrame:
    out = dispersion.consensus(flatten.bookmaker_wide(events(spark, folder)), ["home_team", "away_team"], WIDE)
    return show(out, ["home_team", "away_team"], WIDE, ["bookmaker_count"])


def odds_dispersion(spark: SparkSession, folder: str) -> DataFrame:
    out = dispersion.dispersion_features(
        c.bookmaker_odds(spark, folder), ["event_id", "commence_time", "home_team", "away_team"])
    return show(out, ["event_id", "home_team", "away_team"], dispersion.DISPERSION_COLUMNS)


def flatten_pool_odds(spark: SparkSession, folder: str) -> DataFrame:
    out = flatten.pool_odds(flatten.parse_payload(payload(spark, folder, p.POOL), flatten.POOL_SCHEMA))
    return show(out, ["match_id", "match_date", "home_team", "pool_code", "outcome_key", "outcome", "handicap_line",
                      "update_time"], ["odds"])


def market_rows(spark: SparkSession, folder: str) -> DataFrame:
    return flatten.prediction_markets(flatten.parse_payload(payload(spark, folder, p.MARKETS), flatten.EVENT_MARKET_SCHEMA))


def flatten_prediction_markets(spark: SparkSession, folder: str) -> DataFrame:
    return show(market_rows(spark, folder), ["event_id", "market_id", "outcome", "token_id", "signal_type", "subject"],
                ["probability", "best_bid", "volume", "liquidity"], ["position"])


def yes_no_signals(spark: SparkSession, folder: str) -> DataFrame:
    out = dispersion.yes_no_signals(market_rows(spark, folder))
    return show(out, ["market_id", "outcome", "signal_type"], ["volume", "liquidity"])


def flatten_match_events(spark: SparkSession, folder: str) -> DataFrame:
    out = flatten.match_events(flatten.parse_payload(payload(spark, folder, p.MATCH), flatten.MATCH_SCHEMA))
    return show(out, [n for n in out.columns if n not in ("match_id", "home_score", "away_score")], [],
                ["match_id", "home_score", "away_score"])


def flatten_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    parsed = flatten.parse_payload(payload(spark, folder, p.SENTIMENT), flatten.SENTIMENT_SCHEMA, keep=("p_partkey",))
    out = flatten.sentiment_rows(parsed, ["p_partkey"])
    return show(out, ["p_partkey", "off_field_reasoning"], ["off_field_confidence"],
                [n for n in out.columns if n not in ("p_partkey", "off_field_reasoning", "off_field_confidence")])


def flatten_rating_items(spark: SparkSession, folder: str) -> DataFrame:
    parsed = flatten.parse_payload(payload(spark, folder, p.RATING), flatten.RATING_SCHEMA, keep=("p_partkey",))
    out = flatten.rating_items(parsed, "p_partkey")
    return out.select("id", "rank", "overallRating", "firstName", "lastName", "commonName", "height", "nationality",
                      "team", "position", "pac", "def", "phy")


def explode_groups(spark: SparkSession, folder: str) -> DataFrame:
    groups = table(spark, folder, "customer").selectExpr(
        "map(c_mktsegment, array(concat('T', c_custkey % 90), concat('U', c_nationkey))) as groups")
    return flatten.group_teams(groups)


def static_rating_table(spark: SparkSession, folder: str) -> DataFrame:
    ratings = table(spark, folder, "customer").selectExpr(
        "c_custkey", """map(concat(' ', element_at(array('USA', 'Czechia', 'Korea Republic', 'Peru', 'Curaçao'),
           cast(c_custkey % 5 as int) + 1), if(c_custkey % 3 = 0, concat(' ', c_nationkey), '')), c_acctbal) as ratings""")
    allowed = table(spark, folder, "customer").selectExpr(
        "explode(array('United States', 'Peru', 'Curacao', concat('Peru ', c_nationkey), concat('T', c_custkey % 50))) as team")
    rated, missing = flatten.rating_map(ratings, allowed, "c_custkey")
    return rated.select("team", r6("elo")).unionByName(missing, allowMissingColumns=True)


def match_files(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The landed matches as three overlapping files."""
    rows = c.raw_matches(spark, folder).selectExpr(
        "split(match_id, '-')[0] as match_id", "match_id as seq", "trim(HomeTeam) as home_team",
        "trim(AwayTeam) as away_team", "FTHG as home_score", "FTAG as away_score", "cast(split(match_id, '-')[1] as int) as line")
    names = "element_at(array('韩国', '美国', 'Peru', '沙特'), line % 4 + 1)"
    rows = rows.withColumn("home_team", F.expr(f"if(line % 2 = 0, {names}, home_team)"))
    return {f"round{n}.csv": rows.where(f"line in {lines}").drop("line")
            for n, lines in enumerate(["(1, 2, 3)", "(3, 4, 5)", "(5, 6, 7)"])}


def chinese_team(name: str):
    return canonical(name, "chinese")


def scan_union_files(spark: SparkSession, folder: str) -> DataFrame:
    out = readers.union_sources(match_files(spark, folder), ["match_id"], "seq", chinese_team)
    return show(out, ["match_id", "seq", "source_file", "home_team", "home_team_original", "away_team"], ["home_score", "away_score"])


def federation_team(name: str):
    """Names as the ratings of those years have them: from the page's names, then from the common English ones."""
    return canonical(canonical(name, "chinese"), "ratings")


def scan_union_years(spark: SparkSession, folder: str) -> DataFrame:
    files = match_files(spark, folder)
    out = readers.union_sources(files, ["match_id"], "seq", federation_team, year=dict(zip(files, (2014, 2018, 2022))))
    return show(out, ["worldcup_year", "match_id", "seq", "home_team", "home_team_original"], ["home_score", "away_score"])


def scan_keyed_large(spark: SparkSession, folder: str) -> DataFrame:
    facts = c.appearances(spark, folder)
    games = table(spark, folder, "orders").where("o_orderdate >= '1998-01-01'").selectExpr("o_orderkey as game_id")
    people = table(spark, folder, "customer").where("c_acctbal > 0").selectExpr("c_custkey as player_id")
    out = readers.keyed_rows(facts, {"game_id": games, "player_id": people})
    return show(out, ["game_id", "player_id", "competition_id"], [], ["minutes_played", "goals"])


SPELLINGS = ["USA", " Korea Republic ", "Türkiye", "Cote d'Ivoire", "Congo DR", "Brazil", "Korea, South", "IR Iran", "côte d'ivoire", "T rkiye"]


def canonical_team(spark: SparkSession, folder: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(s) for s in SPELLINGS]), F.expr("cast(c_custkey % 11 % 10 as int) + 1"))
    rows = table(spark, folder, "customer").select("c_custkey", F.when(F.expr("c_custkey % 11 < 10"), name).alias("raw"))
    return rows.select("c_custkey", canonical("raw", "results").alias("results"), text.canonical_nationality("raw").alias("nationality"),
                       canonical("raw", "club_stats", "").alias("club_stats"), canonical("raw", "odds").alias("odds"))


def normalize_person(spark: SparkSession, folder: str) -> DataFrame:
    return c.players(spark, folder).select("player_id", text.normalize_person("display_name").alias("name_key"))


def normalize_person_legacy(spark: SparkSession, folder: str) -> DataFrame:
    return c.players(spark, folder).select("player_id", text.normalize_person_legacy("display_name").alias("name_key"))


def normalize_subject(spark: SparkSession, folder: str) -> DataFrame:
    subjects = F.expr("element_at(array(' United States', 'US', 'IRAN', 'South Korea', 'Spain'), cast(p_partkey % 5 as int) + 1)")
    return table(spark, folder, "part").select("p_partkey", text.normalize_subject(subjects).alias("subject_key"))


def candidate_names(spark: SparkSession, folder: str) -> DataFrame:
    norm = text.normalize_person
    rows = c.players(spark, folder).select("player_id", text.distinct_names(
        norm("display_name"), norm(text.full_name("first_names", "last_names")),
        norm(text.full_name("last_names", "first_names")), norm("last_names"), F.lit("")).alias("names"))
    return rows.select("player_id", F.posexplode("names").alias("position", "name_key"))


RAW_POSITION = """element_at(array('Goalkeeper', 'Centre-Back', 'LB, CM', 'CDM', 'Second Striker', 'st', 'RW/LW', 'Keeper',
  'Sweeper', 'DEFENDER LEFT', 'SW', 'LWB', ' Midfielder '), cast(c_custkey % 14 as int) + 1)"""


def simplify_position(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").selectExpr("c_custkey", f"if(c_custkey % 14 = 13, null, {RAW_POSITION}) as raw")
    return rows.select("c_custkey", *[text.simplify_position("raw", m).alias(m) for m in ("squad", "layout", "rating")])


QUESTION = """element_at(array('Will Spain win the 2026 FIFA World Cup?', 'will France win the world cup?', 'Will T9 advance?',
  'Will Kane win the Golden Boot', 'Will Peru QUALIFY for the finals', 'Can T1 beat T2?', 'Exact Score: T1 2 - 1 T2?',
  'Any Other Score', 'goals 3 - 3', 'nothing'), cast(p_partkey % 10 as int) + 1)"""
TITLE = "element_at(array('World Cup Winner', 'A vs B', 'other', 'song of the world cup'), cast(p_size % 4 as int) + 1)"


def market_texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").selectExpr("p_partkey", f"{QUESTION} as question", f"{TITLE} as title")


def classify_signal(spark: SparkSession, folder: str) -> DataFrame:
    return market_texts(spark, folder).select("p_partkey", text.classify_signal(F.col("question"), F.col("title")).alias("signal_type"))


def extract_subject(spark: SparkSession, folder: str) -> DataFrame:
    return market_texts(spark, folder).select("p_partkey", text.extract_subject(F.col("question")).alias("subject"))


def topic_filter(spark: SparkSession, folder: str) -> DataFrame:
    q, t = F.col("question"), F.col("title")
    return market_texts(spark, folder).select(
        "p_partkey", text.is_tournament_event(q, t).cast("int").alias("is_event"),
        text.is_tournament_trade(q, t).cast("int").alias("is_trade"), text.is_tournament_league(q, t).cast("int").alias("is_league"))


def parse_score_label(spark: SparkSession, folder: str) -> DataFrame:
    return market_texts(spark, folder).select(
        "p_partkey", text.score_from_question(F.col("question")).alias("label"), text.score_outcome(F.col("question")).alias("outcome"))


def clamp_score(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.expr("case p_partkey % 9 when 8 then 'n/a' when 7 then null else cast((p_size - 25) / 4.0 as string) end")
    home, away = numbers.clamp_score(raw), numbers.clamp_score(F.expr("cast(p_partkey % 11 - 5.5 as string)"))
    given = F.expr("case when p_partkey % 3 = 0 then cast(p_size / 2.0 - 12 as string) end")
    diff = F.when(given.isNull(), F.least(F.greatest(home - away, F.lit(-6)), F.lit(6))).otherwise(numbers.clamp_score(given, -6, 6))
    confidence = F.coalesce(numbers.clip(numbers.to_number(F.expr("if(p_size % 7 = 0, 'high', cast(p_size / 40.0 as string))")), 0.0, 1.0), F.lit(0.0))
    return table(spark, folder, "part").select(
        "p_partkey", home.alias("home_overall"), away.alias("away_overall"), diff.alias("diff"), r6(confidence, "confidence"))


def extract_page_candidates(spark: SparkSession, folder: str) -> DataFrame:
    out = pages.page_candidates(table(spark, folder, "pages"), r"/[A-Za-z]{3,}", "page_id", "html")
    return out.select("page_id", "position", "url", "slug_name", "overall", F.length("snippet").alias("snippet_length"))


def avg_available(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").selectExpr(
        f"{c.MATCH_ID} as match_id", "cast(l_quantity as string) as Acceleration",
        "case when l_linenumber % 2 = 0 then 'x' else cast(l_linenumber as string) end as Sprint", "l_discount as Other")
    return rows.select("match_id", r6(numbers.mean_available(rows.columns, ["Acceleration", "Sprint", "Missing"]), "pace"),
                       r6(numbers.mean_available(rows.columns, ["Missing"]), "none"))


def implied_prob(spark: SparkSession, folder: str) -> DataFrame:
    latest = latest_snapshots(spark, folder)
    out = dispersion.normalized_probabilities(latest, ["match_id", "pool_code"])
    return show(out, ["match_id", "pool_code", "outcome"], ["implied", "probability"])


def latest_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return keep_one(c.snapshots(spark, folder), ["match_id", "pool_code", "outcome"], ["fetched_at"], "last")


def equivalent_odds(spark: SparkSession, folder: str) -> DataFrame:
    rows = c.model_probabilities(spark, folder)
    return rows.select("match_id", *[
        r6(dispersion.equivalent_odds(F.col(f"gbm_{i}")), f"closing_{s}_odds") for i, s in enumerate(("home", "draw", "away"))])


def market_pick(spark: SparkSession, folder: str) -> DataFrame:
    return dispersion.market_pick(latest_snapshots(spark, folder), ["match_id", "pool_code"])


QUERIES = {f.__name__: f for f in (
    flatten_bookmaker_long, flatten_bookmaker_wide, odds_consensus, odds_dispersion, flatten_pool_odds,
    flatten_prediction_markets, yes_no_signals, flatten_match_events, flatten_sentiment, flatten_rating_items,
    explode_groups, static_rating_table, scan_union_files, scan_union_years, scan_keyed_large, canonical_team,
    normalize_person, normalize_person_legacy, normalize_subject, candidate_names, simplify_position, classify_signal,
    extract_subject, topic_filter, parse_score_label, clamp_score, extract_page_candidates, avg_available, implied_prob,
    equivalent_odds, market_pick)}
