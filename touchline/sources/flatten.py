"""Nested market, match and rating payloads flattened to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.aliases import canonical_team
from touchline.functions.numbers import to_number
from touchline.functions.text import classify_signal, extract_subject, is_tournament_event, is_tournament_league
from touchline.operators.scan import keep_one

BOOKMAKER_SCHEMA = """struct<id:string, sport_key:string, commence_time:string, home_team:string, away_team:string,
  bookmakers:array<struct<key:string, title:string, last_update:string, markets:array<struct<key:string,
  outcomes:array<struct<name:string, price:double, point:double>>>>>>>"""
POOL_SCHEMA = """struct<matchId:string, matchDate:string, matchTime:string, leagueAbbName:string, leagueAllName:string,
  homeTeamAllName:string, homeTeamAbbName:string, awayTeamAllName:string, awayTeamAbbName:string,
  had:map<string,string>, hhad:map<string,string>, crs:map<string,string>, ttg:map<string,string>, hafu:map<string,string>>"""
EVENT_MARKET_SCHEMA = """struct<id:string, title:string, description:string, slug:string, ticker:string,
  markets:array<struct<id:string, slug:string, question:string, outcomes:string, outcomePrices:string,
  clobTokenIds:string, bestBid:string, bestAsk:string, volume:string, liquidity:string, active:boolean>>>"""
MATCH_SCHEMA = """struct<match_id:bigint, match_date:string, home_team:struct<home_team_name:string>,
  away_team:struct<away_team_name:string>, home_score:int, away_score:int, competition_stage:struct<name:string>,
  stadium:struct<name:string>, referee:struct<name:string>, match_status_360:string>"""
SENTIMENT_SCHEMA = """struct<home_overall:int, away_overall:int, diff:int, confidence:double,
  home_dimensions:struct<morale:int, external:int, media:int, motivation:int>,
  away_dimensions:struct<morale:int, external:int, media:int, motivation:int>, reasoning:string,
  news:array<string>>"""
STAT = "struct<value:int>"
RATING_SCHEMA = f"""struct<id:bigint, rank:int, overallRating:int, firstName:string, lastName:string, commonName:string,
  birthdate:string, height:int, weight:int, nationality:struct<label:string>, team:struct<label:string>,
  position:struct<shortLabel:string>, stats:struct<pac:{STAT}, sho:{STAT}, pas:{STAT}, dri:{STAT}, def:{STAT}, phy:{STAT}>>"""


def parse_payload(df: DataFrame, schema: str, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the payload's top-level fields, with the ``keep`` columns beside them.

    Unnested as an array of one, a payload is parsed once; as a struct it would be parsed anew for each field and filter.
    """
    return df.select(*keep, F.inline(F.array(F.from_json(payload, schema))))


def bookmaker_long(events: DataFrame) -> DataFrame:
    """One row per event, bookmaker and 1X2 outcome; outcomes that are neither side nor draw go."""
    home, away = canonical_team("home_team", "odds"), canonical_team("away_team", "odds")
    rows = (
        events.withColumns({
            "home_team": home, "away_team": away,
            "commence_time": F.try_to_timestamp(F.col("commence_time"), F.lit("yyyy-MM-dd'T'HH:mm:ssX")),
        })
        .select("id", "sport_key", "commence_time", "home_team", "away_team", F.explode("bookmakers").alias("b"))
        .select("*", F.explode("b.markets").alias("m")).where("m.key = 'h2h'")
        .select("*", F.posexplode("m.outcomes").alias("pos", "o"))
    )
    name = canonical_team("o.name", "odds")
    side = (
        F.when(name == F.col("home_team"), "home").when(name == F.col("away_team"), "away")
        .when(F.lower(name).isin("draw", "tie"), "draw")
    )
    local = F.from_utc_timestamp("commence_time", "Asia/Shanghai")
    day = lambda ts: F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit(""))
    return rows.select(
        F.col("id").alias("event_id"), "sport_key", "commence_time", day(F.col("commence_time")).alias("date"),
        day(local).alias("shanghai_date"), "home_team", "away_team", F.col("b.key").alias("bookmaker_key"),
        F.col("b.title").alias("bookmaker_title"), F.col("m.key").alias("market"), side.alias("outcome_key"),
        F.col("o.name").alias("outcome_name"), F.col("o.price").alias("odds"), "pos",
    ).where("outcome_key is not null")


def _first(items: Column, test) -> Column:
    return F.get(F.filter(items, test), 0)


def bookmaker_wide(events: DataFrame, tournament: str | None = None) -> DataFrame:
    """One row per event and bookmaker with 1X2, spread and total prices; first match wins."""
    rows = events.select("*", F.explode("bookmakers").alias("b"))
    market = lambda key: _first(F.col("b.markets"), lambda m: m.key == key).outcomes
    rows = rows.withColumns({"h2h": market("h2h"), "spreads": market("spreads"), "totals": market("totals")})
    named = lambda outcomes, name: _first(F.col(outcomes), lambda o: o["name"] == name)
    home, away = F.col("home_team"), F.col("away_team")
    over, under = F.lit("Over"), F.lit("Under")
    return rows.select(
        F.col("id").alias("event_id"), F.col("commence_time").alias("date"),
        (F.lit(tournament) if tournament else F.col("sport_key")).alias("tournament"), "home_team", "away_team",
        F.col("b.key").alias("bookmaker"), F.col("b.title").alias("bookmaker_title"),
        named("h2h", home).price.alias("closing_home_odds"),
        named("h2h", F.lit("Draw")).price.alias("closing_draw_odds"),
        named("h2h", away).price.alias("closing_away_odds"),
        named("spreads", home).point.alias("closing_handicap_line"),
        named("spreads", home).price.alias("closing_home_handicap_odds"),
        named("spreads", away).point.alias("closing_away_handicap_line"),
        named("spreads", away).price.alias("closing_away_handicap_odds"),
        named("totals", over).point.alias("closing_over_under_line"),
        named("totals", over).price.alias("closing_over_odds"),
        named("totals", under).price.alias("closing_under_odds"),
    )


# Pool payload keys that are not odds, catch-all score keys, half/full-time labels.
POOL_META = ["goalLine", "goalLineValue", "updateDate", "updateTime"]
SIDE_KEYS = {"h": "home_win", "d": "draw", "a": "away_win"}
OTHER_SCORES = {"s1sh": "home_other", "s1sd": "draw_other", "s1sa": "away_other"}
HALF_FULL = {
    "hh": "胜/胜", "hd": "胜/平", "ha": "胜/负",
    "dh": "平/胜", "dd": "平/平", "da": "平/负",
    "ah": "负/胜", "ad": "负/平", "aa": "负/负",
}


def _label(key: Column, labels: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.try_element_at(table, key)


def pool_odds(matches: DataFrame) -> DataFrame:
    """Lottery pools (1X2, handicap, score, total goals, half/full time) to one row per outcome."""
    matches = matches.where(is_tournament_league(F.col("leagueAbbName"), F.col("leagueAllName")))
    pools = F.explode(F.array(*[
        F.struct(F.lit(code).alias("pool_code"), F.col(code).alias("odds_map"))
        for code in ("had", "hhad", "crs", "ttg", "hafu")
    ]))
    rows = (
        matches.select(
            F.col("matchId").alias("match_id"), F.col("matchDate").alias("match_date"), F.col("matchTime").alias("match_time"),
            F.coalesce("homeTeamAllName", "homeTeamAbbName").alias("home_team"),
            F.coalesce("awayTeamAllName", "awayTeamAbbName").alias("away_team"), pools.alias("pool"))
        .select("*", "pool.*").drop("pool")
        .withColumns({
            "line": F.coalesce(F.try_element_at("odds_map", F.lit("goalLine")), F.lit("")),
            "update_time": F.trim(F.concat_ws(" ", F.try_element_at("odds_map", F.lit("updateDate")),
                                              F.try_element_at("odds_map", F.lit("updateTime")))),
        })
        .select("*", F.explode("odds_map").alias("outcome_key", "value"))
    )
    key, pool = F.col("outcome_key"), F.col("pool_code")
    score = F.regexp_extract(key, r"^s(\d{2})s(\d{2})$", 1).try_cast("int"), F.regexp_extract(
        key, r"^s(\d{2})s(\d{2})$", 2).try_cast("int")
    skip = key.isin(POOL_META) | key.endswith("f")
    outcome = (
        F.when(pool.isin("had", "hhad"), _label(key, SIDE_KEYS))
        .when(skip, None)
        .when(pool == "crs", F.coalesce(
            _label(key, OTHER_SCORES), F.when(score[0].isNotNull(), F.concat_ws("-", *score))))
        .when(pool == "ttg", F.when(key == "s7", "7+").otherwise(F.replace(key, F.lit("s"), F.lit(""))))
        .otherwise(_label(key, HALF_FULL))
    )
    return (
        rows.withColumns({"outcome": outcome, "odds": to_number("value")})
        .where("outcome is not null and odds is not null")
        .select("match_id", "match_date", "match_time", "home_team", "away_team", "pool_code", "outcome_key", "outcome",
                "odds", F.when(pool.isin("had", "hhad"), F.col("line")).otherwise("").alias("handicap_line"), "update_time")
    )


def _text_list(col: Column) -> Column:
    """JSON list in a text cell; anything else is an empty list."""
    return F.coalesce(F.from_json(col, "array<string>"), F.array().cast("array<string>"))


def prediction_markets(events: DataFrame) -> DataFrame:
    """Event -> market -> outcome; prices and tokens go by position, short lists leave nulls."""
    texts = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "description", "slug", "ticker")]
    rows = (
        events.where(is_tournament_event(*texts))
        .select(F.col("id").alias("event_id"), F.coalesce("title", F.lit("")).alias("event_title"), F.explode("markets").alias("m"))
        .select("event_id", "event_title", "m.*")
        .withColumns({"outcomes": _text_list(F.col("outcomes")), "prices": _text_list(F.col("outcomePrices")),
                      "tokens": _text_list(F.col("clobTokenIds"))})
        .select("*", F.posexplode("outcomes").alias("position", "outcome"))
    )
    question = F.coalesce("question", F.lit(""))
    return rows.select(
        "event_id", "event_title", F.col("id").alias("market_id"), question.alias("question"),
        classify_signal(question, F.col("event_title")).alias("signal_type"), extract_subject(question).alias("subject"),
        "position", "outcome", to_number(F.get("prices", "position")).alias("probability"),
        F.get("tokens", "position").alias("token_id"),
        *[to_number(c).alias(n) for c, n in (("bestBid", "best_bid"), ("bestAsk", "best_ask"), ("volume", "volume"),
                                             ("liquidity", "liquidity"))],
        "active",
    )


def match_events(matches: DataFrame) -> DataFrame:
    return matches.select(
        "match_id", F.col("match_date").try_cast("date").alias("date"), F.col("home_team.home_team_name").alias("home_team"),
        F.col("away_team.away_team_name").alias("away_team"), "home_score", "away_score",
        F.col("competition_stage.name").alias("competition_stage"), F.col("stadium.name").alias("stadium"),
        F.col("referee.name").alias("referee"), "match_status_360",
    )


def sentiment_rows(results: DataFrame, keys: list[str]) -> DataFrame:
    """Match sentiment to a flat row; missing scores are 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    scores = {f"off_field_{n}": zero(n) for n in ("home_overall", "away_overall", "diff", "confidence")}
    for side in ("home", "away"):
        for dim in ("morale", "external", "media", "motivation"):
            scores[f"off_field_{side}_{dim}"] = zero(f"{side}_dimensions.{dim}")
    return results.select(
        *keys, *[v.alias(k) for k, v in scores.items()], F.coalesce("reasoning", F.lit("")).alias("off_field_reasoning"),
        F.coalesce(F.size("news"), F.lit(0)).alias("off_field_news_count"),
    )


def rating_items(items: DataFrame, seq: str) -> DataFrame:
    """Nested rating items to flat rows; the first in ``seq`` per id counts."""
    flat = items.select(
        "id", seq, "rank", "overallRating", "firstName", "lastName", "commonName", "birthdate", "height", "weight",
        F.col("nationality.label").alias("nationality"), F.col("team.label").alias("team"),
        F.col("position.shortLabel").alias("position"),
        *[F.col(f"stats.{s}.value").alias(s) for s in ("pac", "sho", "pas", "dri", "def", "phy")],
    )
    return keep_one(flat, ["id"], [seq]).drop(seq)


def group_teams(payloads: DataFrame) -> DataFrame:
    """Distinct team names of a group -> teams map."""
    return payloads.select(F.explode("groups").alias("grp", "teams")).select(F.explode("teams").alias("team")).distinct()


def rating_map(payloads: DataFrame, allowed: DataFrame, seq: str) -> tuple[DataFrame, DataFrame]:
    """Team -> rating map to rows for the allowed teams (last entry wins), and the teams without one."""
    rows = payloads.select(seq, F.explode("ratings").alias("alias", "elo")).select(
        canonical_team("alias", "legacy").alias("team"), F.struct(seq, "alias").alias("o"), "elo")
    last = rows.groupBy("team").agg(F.max_by("elo", "o").alias("elo"))
    teams = allowed.select("team").distinct()
    return teams.join(last, "team"), teams.join(last, "team", "left_anti")
