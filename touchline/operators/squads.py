"""Squad aggregates: team means, top players, club form, line power and matchups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.numbers import to_number
from touchline.operators.scan import keep_one


def _best(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows per group; Spark prunes to ``n`` per group before the shuffle."""
    window = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n)


def team_aggregates(players: DataFrame, means: Sequence[str], sums: Sequence[str], flags: Sequence[str]) -> DataFrame:
    return players.groupBy("team").agg(
        F.count("display_name").alias("squad_player_count"),
        *[F.sum(F.col(c).cast("int")).alias(f"{c}_count") for c in flags],
        *[F.avg(c).alias(f"{c}_mean") for c in means], *[F.sum(c).alias(f"{c}_sum") for c in sums])


def top_players(players: DataFrame, value: str, label: str, seq: str) -> DataFrame:
    """Best, top-3 and top-11 sums and means of ``value`` per team, from the 11 best rows."""
    known = players.dropna(subset=[value])
    top = _best(known, ["team"], [F.desc(value), F.col(seq)], 11)
    three = F.when(F.col("_rank") <= 3, F.col(value))
    stats = top.groupBy("team").agg(
        F.max(value).alias(f"squad_top1_{label}"), F.sum(three).alias(f"squad_top3_{label}_sum"),
        F.avg(three).alias(f"squad_top3_{label}_mean"), F.count("*").alias(f"squad_top11_{label}_count"),
        F.sum(value).alias(f"squad_top11_{label}_sum"), F.avg(value).alias(f"squad_top11_{label}_mean"))
    return players.select("team").distinct().join(stats, "team", "left").fillna(0, subset=[f"squad_top11_{label}_count"])


def first_available(df: DataFrame, target: str, fallbacks: Sequence[str]) -> Column:
    """``target``, else the first fallback column that exists and has a value."""
    names = [c for c in [target, *fallbacks] if c in df.columns]
    return F.coalesce(*[to_number(c) for c in names]) if names else F.lit(None).cast("double")


# Club-form columns and the columns that stand in for them.
FORM_FALLBACKS = {
    "player_club_minutes": ["club_stats_minutes", "transfermarkt_stats_tm_minutes"],
    "player_club_goals": ["club_stats_goals", "transfermarkt_stats_tm_goals"],
    "player_club_assists": ["club_stats_assists", "transfermarkt_stats_tm_assists"],
    "player_club_shots": ["club_stats_shots"],
    "player_club_tackles": ["club_stats_tackles_won"],
    "player_club_interceptions": ["club_stats_interceptions"],
}
FORM_STATS = ["minutes", "goals", "assists", "xg", "npxg", "xa", "shots", "key_passes", "tackles", "interceptions"]
# Columns a team's players are ranked by; the first with any value counts.
RANK_PRIORITY = ["tm_profile_market_value_in_eur", "kaggle_fc26_overallRating", "player_club_minutes"]


def with_fallbacks(players: DataFrame, matched: str = "matched_player_club_stats") -> DataFrame:
    filled = players.withColumns({t: first_available(players, t, f) for t, f in FORM_FALLBACKS.items()})
    flag = F.coalesce(F.col(matched), F.lit(False)) if matched in players.columns else F.lit(False)
    return filled.withColumn(matched, flag | F.col("player_club_minutes").isNotNull())


def club_form(players: DataFrame, seq: str) -> DataFrame:
    """Per-90 club form of each team's 11 top players.

    The rank column is chosen per team from counts (one small aggregate), then the 11 best rows are
    cut before the shuffle and summed; a sum without any value stays null.
    """
    players = with_fallbacks(players)
    rank_columns = [c for c in RANK_PRIORITY if c in players.columns]
    counts = players.groupBy("team").agg(*[F.count(to_number(c)).alias(f"_n{i}") for i, c in enumerate(rank_columns)])
    rows = players.join(counts, "team")
    value = F.coalesce(*[F.when(F.col(f"_n{i}") > 0, F.coalesce(to_number(c), F.lit(-1.0))) for i, c in enumerate(rank_columns)], F.lit(-1.0))
    top = _best(rows.withColumn("_value", value), ["team"], [F.desc("_value"), F.col(seq)], 11)
    has = F.col("player_club_minutes").isNotNull()
    stats = {s: (F.sum(F.when(has, to_number(f"player_club_{s}"))) if f"player_club_{s}" in players.columns
                 else F.lit(None).cast("double")) for s in FORM_STATS}
    out = top.groupBy("team").agg(
        F.count("*").alias("squad_club_form_top11_count"), F.count_if(has).alias("squad_club_form_top11_matched_count"),
        F.avg("player_club_minutes").alias("squad_club_form_minutes_mean_top11"), *[v.alias(s) for s, v in stats.items()])
    out = out.withColumns({
        "goal_contrib": F.col("goals") + F.col("assists"), "tackles_interceptions": F.col("tackles") + F.col("interceptions"),
        "goal_minus_xg": F.col("goals") - F.col("xg")})
    per90 = ["goals", "assists", "goal_contrib", "xg", "npxg", "goal_minus_xg", "xa", "shots", "key_passes", "tackles_interceptions"]
    minutes = F.when(F.col("minutes") > 0, F.col("minutes"))
    return out.select(
        "team", "squad_club_form_top11_count", "squad_club_form_top11_matched_count",
        minutes.alias("squad_club_form_minutes_sum_top11"), "squad_club_form_minutes_mean_top11",
        *[(F.col(s) / minutes * 90).alias(f"squad_club_form_{s}_per90_top11") for s in per90],
        (F.col("goals") / F.when(F.col("shots") > 0, F.col("shots"))).alias("squad_club_form_goals_per_shot_top11"))


def merge_player_stats(stats: DataFrame, keys: Sequence[str], numeric: Sequence[str], texts: Sequence[str], seq: str) -> DataFrame:
    """Several rows of a player to one: numbers summed (0 when none is known), first known text."""
    return stats.dropna(subset=list(keys)).groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in numeric],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in texts])


def appearance_totals(appearances: DataFrame) -> DataFrame:
    """Per player: games, minutes, goals, cards, first and last day, competitions (a small set)."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    return appearances.groupBy("player_id").agg(
        F.count_distinct("game_id").alias("appearances"), F.sum(F.coalesce("minutes_played", F.lit(0))).alias("minutes"),
        total("goals"), total("assists"), total("yellow_cards"), total("red_cards"),
        F.min("date").alias("first_match_date"), F.max("date").alias("last_match_date"),
        F.array_join(F.sort_array(F.collect_set("competition_id")), ",").alias("competitions"))


def start_counts(lineups: DataFrame) -> DataFrame:
    return lineups.groupBy("player_id").agg(F.count_if(F.lower("type").contains("starting")).alias("starts"))


def club_stats(matched: DataFrame, appearances: DataFrame, starts: DataFrame, season: int) -> DataFrame:
    """Matched players with their totals in the club-stats layout."""
    out = matched.join(appearances, "player_id", "left").join(starts, "player_id", "left")
    return out.select(
        F.col("team_norm").alias("team"), "player_name", F.coalesce("club_name", "club_name_from_squad").alias("club_name"),
        F.lit(season).alias("season"), F.col("competitions").alias("competition"), "minutes", "goals", "assists", "starts",
        "appearances", "player_id", "yellow_cards", "red_cards", "market_value_eur")


def coverage_report(matched: DataFrame, stats: DataFrame) -> DataFrame:
    squads = matched.groupBy("team").agg(F.count("player_name").alias("squad_players"), F.count_if("matched").alias("matched_players"))
    totals = stats.groupBy("team").agg(F.count("appearances").alias("players_with_appearances"), F.sum("minutes").alias("total_minutes"))
    out = squads.join(totals, "team", "left")
    return out.withColumns({
        "matched_rate": F.col("matched_players") / F.col("squad_players"),
        "appearance_rate": F.coalesce("players_with_appearances", F.lit(0)) / F.col("squad_players")})


# Weight of each attribute per position.
POSITION_WEIGHTS = {
    "FW": {"pace": 1.1, "shooting": 1.3, "passing": 0.9, "dribbling": 1.1, "defending": 0.1, "physicality": 0.9},
    "MID": {"pace": 1.0, "shooting": 0.9, "passing": 1.3, "dribbling": 1.2, "defending": 0.9, "physicality": 1.0},
    "DF": {"pace": 1.0, "shooting": 0.2, "passing": 0.8, "dribbling": 0.7, "defending": 1.4, "physicality": 1.2},
    "GK": {"pace": 0.5, "shooting": 0.1, "passing": 0.5, "dribbling": 0.5, "defending": 1.5, "physicality": 1.0},
}


def combat_power(position: Column, attribute) -> Column:
    out = F
    for name, weights in POSITION_WEIGHTS.items():
        parts = [F.coalesce(attribute(a), F.lit(0.0)) * w for a, w in weights.items()]
        out = out.when(position == name, parts[0] + parts[1] + parts[2] + parts[3] + parts[4] + parts[5])
    return out.otherwise(0.0)


def line_power(players: DataFrame) -> DataFrame:
    """Attack, midfield and defence per team, raised by club chemistry (three or more clubmates)."""
    position = F.upper(F.trim("simplified_position"))
    rows = players.withColumns({"_position": position, "_power": combat_power(position, F.col)})
    part = lambda *names: F.sum(F.when(F.col("_position").isin(*names), F.col("_power")).otherwise(0.0))
    lines = rows.groupBy("team_name", F.trim(F.coalesce("club_name", F.lit(""))).alias("_club")).agg(
        F.count("*").alias("_n"), part("FW").alias("_fw"), part("MID").alias("_mid"), part("DF", "GK").alias("_df"))
    mates = F.max(F.when(F.col("_club") != "", F.col("_n")))
    out = lines.groupBy("team_name").agg(
        F.sum("_fw").alias("_fw"), F.sum("_mid").alias("_mid"), F.sum("_df").alias("_df"),
        F.sum("_n").alias("player_count"), mates.alias("_mates"))
    out = out.withColumn("chemistry_bonus", F.when(F.col("_mates") >= 3, 1.0 + F.col("_mates") * 0.015).otherwise(1.0))
    return out.select("team_name", *[(F.col(c) * F.col("chemistry_bonus")).alias(n) for c, n in (
        ("_fw", "team_attack"), ("_mid", "team_midfield"), ("_df", "team_defense"))], "chemistry_bonus", "player_count")


MATCHUP = ["feat_home_attack_vs_away_defense", "feat_away_attack_vs_home_defense", "feat_midfield_control_diff",
           "feat_home_chemistry", "feat_away_chemistry"]


def matchup_features(matches: DataFrame, power: DataFrame) -> DataFrame:
    """Line power of both sides against each other; a team without players counts 0, chemistry 1."""
    out = matches
    lines = {"team_attack": 0.0, "team_midfield": 0.0, "team_defense": 0.0, "chemistry_bonus": 1.0}
    for side in ("home", "away"):
        out = out.join(power.select(F.col("team_name").alias(f"{side}_team"), *[F.col(c).alias(f"_{side}_{c}") for c in lines]), f"{side}_team", "left")
    v = lambda side, c: F.coalesce(F.col(f"_{side}_{c}"), F.lit(lines[c]))
    values = [v("home", "team_attack") - v("away", "team_defense"), v("away", "team_attack") - v("home", "team_defense"),
              v("home", "team_midfield") - v("away", "team_midfield"), v("home", "chemistry_bonus"), v("away", "chemistry_bonus")]
    return out.withColumns(dict(zip(MATCHUP, values))).drop(*[f"_{s}_{c}" for s in ("home", "away") for c in lines])


def rank_top11(players: DataFrame, attributes: Sequence[str], seq: str) -> DataFrame:
    """The 11 best per team by overall, then attribute sum; players without attributes are left out."""
    total = F.lit(0.0)
    for a in attributes:
        total = total + F.coalesce(to_number(a), F.lit(0.0))
    rows = players.withColumns({"_sum": total, "overall": F.coalesce(to_number("overall"), F.lit(0.0))}).where("_sum > 0")
    return _best(rows, ["team_name"], [F.desc("overall"), F.desc("_sum"), F.col(seq)], 11).drop("_sum")


def top11_with_fallback(needed: DataFrame, squad: DataFrame, national: DataFrame, seq: str) -> tuple[DataFrame, DataFrame]:
    """Official squad's top 11 per (year, team); below 8 the national top 11 when that is larger.

    Returns the chosen players and one coverage row per needed team, ``missing`` when nobody is known.
    """
    team = ["worldcup_year", "team_name"]
    official = _best(squad, team, [F.desc("overall"), F.col(seq)], 11)
    unique = keep_one(national.withColumn("_low", -F.col("overall")), [*team, "name_key"], ["_low", seq]).drop("_low")
    fallback = _best(unique, team, [F.desc("overall"), F.col(seq)], 11)
    size = lambda d, n: d.groupBy(*team).agg(F.count("*").alias(n))
    counts = needed.join(size(official, "_a"), team, "left").join(size(fallback, "_b"), team, "left").fillna(0, subset=["_a", "_b"])
    use_b = (F.col("_a") < 8) & (F.col("_b") > F.col("_a"))
    coverage = counts.select(
        *team, F.when(use_b, F.col("_b")).otherwise(F.col("_a")).alias("selected_players"),
        F.when(use_b, "national_top11_fallback").when(F.col("_a") > 0, "official_squad_matched").otherwise("missing").alias("selection_source"))
    chosen = official.withColumn("selection_source", F.lit("official_squad_matched")).unionByName(
        fallback.withColumn("selection_source", F.lit("national_top11_fallback")), allowMissingColumns=True)
    return chosen.join(coverage, [*team, "selection_source"], "left_semi").drop("_rank"), coverage


def squads_to_ratings(ratings: DataFrame, squads: DataFrame, seq: str) -> DataFrame:
    """Ratings of squad members: by year, team and name, or without a team by year and name; the best
    overall per (year, team, name) counts."""
    keep = [c for c in ratings.columns if c != "team_name"]
    squads = squads.select("worldcup_year", "team_name", "name_key").distinct()
    with_team = ratings.where("team_name <> ''").join(squads, ["worldcup_year", "team_name", "name_key"], "left_semi")
    without = ratings.where("team_name = ''").select(*keep).join(squads, ["worldcup_year", "name_key"])
    both = with_team.unionByName(without).withColumn("_low", -F.col("overall"))
    return keep_one(both, ["worldcup_year", "team_name", "name_key"], ["_low", seq]).drop("_low")
