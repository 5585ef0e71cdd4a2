"""Queries over players, squads and ratings: resolution, aggregates, feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.text import distinct_names, full_name, normalize_person, normalize_person_legacy
from touchline.operators import features, ratingfiles, resolve, squads
from touchline.operators.resolve import Rule
from touchline.plans import carriers as c
from touchline.plans.common import show
from touchline.session import cut_lineage
from touchline.sources.tables import table

norm = normalize_person


def people(spark: SparkSession, folder: str) -> DataFrame:
    """Squad players with their normalized candidate names, which are folded by all cores however few files there are."""
    return c.players(spark, folder).repartition("player_id").withColumns({
        "last_norm": norm("last_names"),
        "names": distinct_names(norm("display_name"), norm(full_name("last_names", "first_names")))})


def source(spark: SparkSession, folder: str) -> DataFrame:
    return c.player_source(spark, folder).repartition("seq").withColumns({
        "name_norm": norm(full_name("first_name", "last_name")), "common_norm": F.nullif(norm("common_name"), F.lit("")),
        "source_last": norm("last_name")}).withColumnsRenamed({"birthdate": "source_dob"})


NAME, DOB, NAT = "name", "birthdate", "team"
R_NAME, R_COMMON, R_DOB, R_NAT = "name_norm", "common_norm", "source_dob", "nationality"


def ratings_ladder(spark: SparkSession, folder: str) -> DataFrame:
    rules = [
        Rule("name_dob", 1, [NAME, DOB], [R_NAME, R_DOB]),
        Rule("common_name_dob", 1, [NAME, DOB], [R_COMMON, R_DOB]),
        Rule("name_nationality", 2, [NAME, NAT], [R_NAME, R_NAT]),
        Rule("common_name_nationality", 2, [NAME, NAT], [R_COMMON, R_NAT]),
        Rule("last_name_dob_nationality", 3, ["last_norm", DOB, NAT], ["source_last", R_DOB, R_NAT], "first", False),
    ]
    return resolve.ladder(people(spark, folder), source(spark, folder), "player_id", "names", rules, "seq", ["seq", "overall"])


def er_ratings_ladder(spark: SparkSession, folder: str) -> DataFrame:
    return show(ratings_ladder(spark, folder), ["player_id", "method"], ["overall"], ["seq"])


def er_local_stats(spark: SparkSession, folder: str) -> DataFrame:
    rules = [Rule("team_name", 1, [NAT, NAME], [R_NAT, R_NAME])]
    out = resolve.ladder(people(spark, folder), source(spark, folder), "player_id", "names", rules, "seq", ["seq", "overall"])
    return show(out, ["player_id", "method"], ["overall"], ["seq"])


def exact_rules() -> list[Rule]:
    return [
        Rule("name_dob_country", 1, [NAME, DOB, NAT], [R_NAME, R_DOB, R_NAT]),
        Rule("last_dob_country", 2, ["last_norm", DOB, NAT], ["source_last", R_DOB, R_NAT], "first", False)]


def blocks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact matches, the unmatched players and the source, both with block columns and token lists.

    Names and exact matches are read several times, so they are written once.
    """
    left, right = cut_lineage(people(spark, folder)), cut_lineage(source(spark, folder))
    exact = cut_lineage(resolve.ladder(left, right, "player_id", "names", exact_rules(), "seq", ["seq", "overall"]))
    tokens = F.array_sort(F.array_distinct(F.flatten(F.transform("names", lambda n: F.split(n, " ")))))
    rest = left.join(exact, "player_id", "left_anti").withColumn("tokens", tokens)
    right = right.selectExpr("*", "source_dob as birthdate", "nationality as team").withColumn("source_tokens", resolve.name_tokens(F.col(R_NAME)))
    return exact, rest, right


BLOCK = ["birthdate", "team"]


def er_player_id(spark: SparkSession, folder: str) -> DataFrame:
    exact, rest, right = blocks(spark, folder)
    fuzzy = resolve.best_token_overlap(rest, right, "player_id", "tokens", "source_tokens", BLOCK, "seq", ["seq", "overall"])
    out = exact.unionByName(fuzzy.withColumn("method", F.lit("dob_country_token")))
    return show(out, ["player_id", "method"], ["overall"], ["seq"])


def er_profile(spark: SparkSession, folder: str) -> DataFrame:
    exact, rest, right = blocks(spark, folder)
    sole = cut_lineage(resolve.sole_in_block(rest, right, "player_id", BLOCK, ["seq", "overall"]))
    fuzzy = resolve.best_token_overlap(rest.join(sole, "player_id", "left_anti"), right, "player_id", "tokens", "source_tokens", BLOCK, "seq", ["seq", "overall"])
    out = exact.drop("method").unionByName(sole).unionByName(fuzzy)
    return show(out, ["player_id"], ["overall"], ["seq"])


def er_ratings_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    left = cut_lineage(people(spark, folder))
    right = cut_lineage(source(spark, folder)).selectExpr("*", "source_dob as birthdate", "nationality as team")
    rules = [Rule("exact", 1, [NAME, DOB, NAT], [R_NAME, R_DOB, R_NAT])]
    exact = cut_lineage(resolve.ladder(left, right.drop("birthdate", "team"), "player_id", "names", rules, "seq", ["seq", "overall"]))
    rest = left.join(exact, "player_id", "left_anti")
    fuzzy = resolve.fuzzy_block_match(rest, right, "player_id", "names", "name_norm", BLOCK, "seq", ["seq", "overall"])
    out = exact.withColumn("match_score", F.lit(1.0)).unionByName(fuzzy.withColumn("method", F.lit("fuzzy")))
    return show(out, ["player_id", "method"], ["match_score", "overall"], ["seq"])


def er_supplement(spark: SparkSession, folder: str) -> DataFrame:
    _, rest, _ = blocks(spark, folder)
    extra = c.players(spark, folder).selectExpr(
        "player_id as seq", "team as nationality", "concat(last_names, ', ', first_names) as full_name", "shooting as overall",
        "case when player_id % 2 = 0 then birthdate end as source_dob").withColumn("name_norm", norm("full_name"))
    rules = [Rule("name_dob_team", 1, [NAME, DOB, NAT], [R_NAME, R_DOB, R_NAT]), Rule("name_team", 2, [NAME, NAT], [R_NAME, R_NAT])]
    out = resolve.ladder(rest, extra, "player_id", "names", rules, "seq", ["seq", "overall"])
    return show(out, ["player_id", "method"], ["overall"], ["seq"])


def raw_club_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Club statistics split by competition, keyed by team and normalized name."""
    who = c.players(spark, folder).select("player_id", F.col("team").alias("team_norm"), norm("display_name").alias("player_norm"), "club")
    return c.appearances(spark, folder).join(who, "player_id").selectExpr(
        "team_norm", "player_norm", "game_id", "cast(minutes_played as double) as minutes", "cast(goals as double) as goals",
        "case when minutes_played > 45 then minutes_played / 30 end as xg", "cast(null as double) as npxg",
        "club as club_name", "concat(game_id, '-', competition_id, '-', minutes_played, '-', club, '-', goals, '-', date) as seq",
        "case when competition_id = 'A' then competition_id end as source")


def merged_club_stats(spark: SparkSession, folder: str) -> DataFrame:
    return squads.merge_player_stats(raw_club_stats(spark, folder), ["team_norm", "player_norm"], ["minutes", "goals", "xg", "npxg"], ["club_name", "source"], "seq")


def player_stat_preagg(spark: SparkSession, folder: str) -> DataFrame:
    return show(merged_club_stats(spark, folder), ["team_norm", "player_norm", "club_name", "source"], ["minutes", "goals", "xg", "npxg"])


def er_club_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = merged_club_stats(spark, folder).withColumn("seq", F.lit(0))
    rules = [Rule("team_name", 1, [NAT, NAME], ["team_norm", "player_norm"])]
    out = resolve.ladder(people(spark, folder), stats, "player_id", "names", rules, "seq", ["minutes", "goals"])
    return show(out, ["player_id"], ["minutes", "goals"])


def matched_players(spark: SparkSession, folder: str) -> DataFrame:
    return c.players(spark, folder).selectExpr(
        "player_id", "team as team_norm", "team", "display_name as player_name", "if(player_id % 4 = 0, null, club) as club_name",
        "'squad club' as club_name_from_squad", "value as market_value_eur", "player_id % 3 > 0 as matched")


def season_rows(spark: SparkSession, folder: str) -> DataFrame:
    return c.appearances(spark, folder).where("season >= 1998").join(
        matched_players(spark, folder).where("matched").select("player_id"), "player_id", "left_semi")


TOTALS = ["appearances", "minutes", "goals", "assists", "yellow_cards", "red_cards"]


def appearance_agg(spark: SparkSession, folder: str) -> DataFrame:
    return show(squads.appearance_totals(season_rows(spark, folder)), ["player_id", "first_match_date", "last_match_date", "competitions"], [], TOTALS)


def starts_agg(spark: SparkSession, folder: str) -> DataFrame:
    return squads.start_counts(season_rows(spark, folder))


def club_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = season_rows(spark, folder)
    return squads.club_stats(matched_players(spark, folder).where("matched").drop("team"), squads.appearance_totals(rows), squads.start_counts(rows), 1998)


def build_club_stats(spark: SparkSession, folder: str) -> DataFrame:
    return show(club_table(spark, folder), ["player_id", "team", "player_name", "club_name", "competition"], ["market_value_eur"], [*TOTALS, "starts", "season"])


def coverage_report(spark: SparkSession, folder: str) -> DataFrame:
    out = squads.coverage_report(matched_players(spark, folder), club_table(spark, folder))
    return show(out, ["team"], ["matched_rate", "appearance_rate"], ["squad_players", "matched_players", "players_with_appearances", "total_minutes"])


def unmatched_players(spark: SparkSession, folder: str) -> DataFrame:
    rows = matched_players(spark, folder).where(~F.coalesce("matched", F.lit(False))).where(F.lower("team") != "nation_0")
    return rows.select("player_id", "team")


def team_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    rows = c.players(spark, folder).withColumn("matched", F.expr("player_id % 3 > 0"))
    out = squads.team_aggregates(rows, ["pace", "shooting", "value"], ["pace"], ["matched"])
    return show(out, ["team"], ["pace_mean", "shooting_mean", "value_mean", "pace_sum"], ["squad_player_count", "matched_count"])


def topk_team(spark: SparkSession, folder: str) -> DataFrame:
    out = squads.top_players(c.players(spark, folder), "value", "tm_value", "player_id")
    return show(out, ["team"], [n for n in out.columns if n != "team"])


def form_players(spark: SparkSession, folder: str) -> DataFrame:
    """Players with partial club statistics; whole teams lack values, ratings or minutes."""
    n = "cast(substr(team, 8) as int)"
    return c.players(spark, folder).selectExpr(
        "player_id", "team", f"case when {n} % 3 > 0 then value end as tm_profile_market_value_in_eur",
        f"case when {n} % 2 = 0 then pace end as kaggle_fc26_overallRating",
        f"case when player_id % 4 > 0 and {n} % 7 > 0 then shooting * 20 end as player_club_minutes", "case when player_id % 3 = 0 then 900.0 end as club_stats_minutes",
        "case when player_id % 5 > 0 then passing / 10 end as player_club_goals", "dribbling / 20 as player_club_assists",
        f"case when {n} % 4 > 0 then pace / 12.3 end as player_club_xg", "defending as club_stats_shots",
        "cast(null as double) as player_club_key_passes", "physicality as player_club_tackles", "pace as player_club_interceptions")


def coalesce_fallback(spark: SparkSession, folder: str) -> DataFrame:
    out = squads.with_fallbacks(form_players(spark, folder))
    return show(out.withColumn("matched", F.col("matched_player_club_stats").cast("int")), ["player_id", "matched"],
                ["player_club_minutes", "player_club_goals", "player_club_shots"])


def club_form_top11(spark: SparkSession, folder: str) -> DataFrame:
    out = squads.club_form(form_players(spark, folder), "player_id")
    return show(out, ["team"], [n for n in out.columns if n != "team"])


def lineup(spark: SparkSession, folder: str) -> DataFrame:
    return c.players(spark, folder).selectExpr(
        "player_id", "concat('T', player_id % 60) as team_name", "display_name as player_name", "lower(position) as simplified_position",
        "if(player_id % 6 = 0, '', club) as club_name", *c.ATTRIBUTES, "pace + passing as overall")


def team_line_power(spark: SparkSession, folder: str) -> DataFrame:
    return show(squads.line_power(lineup(spark, folder)), ["team_name"], ["team_attack", "team_midfield", "team_defense", "chemistry_bonus"], ["player_count"])


def matchup_features(spark: SparkSession, folder: str) -> DataFrame:
    return show(squads.matchup_features(c.matches(spark, folder), squads.line_power(lineup(spark, folder))), ["match_id"], squads.MATCHUP)


def rank_top11(spark: SparkSession, folder: str) -> DataFrame:
    rows = lineup(spark, folder).withColumns({a: F.when(F.expr("player_id % 8 > 0"), F.col(a)) for a in c.ATTRIBUTES})
    return squads.rank_top11(rows, c.ATTRIBUTES, "player_id").select("player_id", "team_name")


def yearly(spark: SparkSession, folder: str) -> DataFrame:
    return lineup(spark, folder).selectExpr("player_id", "cast(2010 + player_id % 4 * 4 as int) as worldcup_year", "team_name", "overall",
                                            "player_name").withColumn("name_key", normalize_person_legacy("player_name"))


def top11_with_fallback(spark: SparkSession, folder: str) -> DataFrame:
    rows = yearly(spark, folder)
    needed = rows.select("worldcup_year", "team_name").distinct().unionByName(rows.selectExpr("worldcup_year", "concat('X', player_id % 5) as team_name").distinct())
    # The official squads name most players under teams that are not asked for.
    official = rows.withColumn("team_name", F.expr("if(player_id % 7 > 4, team_name, concat('Z', team_name))"))
    chosen, coverage = squads.top11_with_fallback(needed, official, rows, "player_id")
    counted = chosen.groupBy("worldcup_year", "team_name", "selection_source").agg(F.sum("overall").alias("overall"))
    out = coverage.join(counted, ["worldcup_year", "team_name", "selection_source"], "left")
    return show(out, ["worldcup_year", "team_name", "selection_source"], ["overall"], ["selected_players"])


def squads_to_ratings(spark: SparkSession, folder: str) -> DataFrame:
    rows = yearly(spark, folder)
    ratings = rows.withColumn("team_name", F.when(F.expr("player_id % 3 = 0"), F.lit("")).otherwise(F.col("team_name")))
    listed = rows.withColumn("name_key", F.expr("if(player_id % 5 > 0, name_key, concat('zz ', name_key))"))
    out = squads.squads_to_ratings(ratings, listed, "player_id")
    return show(out, ["worldcup_year", "team_name", "name_key", "player_id"], ["overall"])


def clean_squad(spark: SparkSession, folder: str) -> DataFrame:
    raw = c.players(spark, folder).selectExpr(
        "player_id", "if(player_id % 4 = 0, element_at(array('Bosnia-Herzegovina', 'Korea, South', 'iR irAN', 'turkiye', 'Nowhere'), "
        "cast(player_id % 5 as int) + 1), concat(' ', team)) as team", "display_name",
        "if(player_id % 9 = 0, 'unknown', date_format(birthdate, 'd/M/yyyy')) as date_of_birth")
    return show(features.clean_squad(raw), ["player_id", "team_norm", "birthdate"], [])


def squad_layout(spark: SparkSession, folder: str) -> DataFrame:
    return ratingfiles.team_year_key(yearly(spark, folder)).select("player_id", "team_key", "real_team_name")


def standardize_ratings(spark: SparkSession, folder: str) -> DataFrame:
    out = ratingfiles.standard_ratings(rating_files(spark, folder))
    return show(out, ["seq", "worldcup_year", "team_name", "player_name", "simplified_position", "club_name", "name_key"], ["pace", "shooting", "overall"])


def rating_files(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three landed rating layouts."""
    rows = c.players(spark, folder)
    cards = rows.where("player_id % 3 = 0").selectExpr(
        "player_id as seq", "if(player_id % 12 = 0, '', concat(' ', display_name)) as NAME", "'RB, CB' as POSITION", "club as CLUB", "pace as PACE",
        "shooting as SHOOTING", "passing as PASSING", "dribbling as DRIBBLING", "defending as DEFENDING", "physicality as PHYSICAL", "'bad' as RATING")
    career = rows.where("player_id % 3 = 1").selectExpr(
        "player_id as seq", "display_name as Name", "if(player_id % 2 = 0, 'Iran', team) as Nationality", "'ST LW' as `Preferred Positions`", "club as Club",
        "pace as Acceleration", "cast(shooting as string) as `Sprint speed`", "passing as Finishing", "'x' as Volleys", "physicality as Strength", "pace + 1 as Overall")
    modern = rows.where("player_id % 3 = 2").selectExpr(
        "player_id as seq", "display_name as Name", "team as Country", "position as Position", "if(player_id % 13 = 0, 'ICON club', club) as Club",
        "if(player_id % 10 = 0, 'Hero card', 'base') as Version", "pace as PAC", "shooting as SHO", "passing as PAS", "dribbling as DRI",
        "defending as DEF", "physicality as PHY", "pace + 2 as Ratings")
    return {"cards": cards, "career": career, "modern": modern}


def squad_rows_by_year(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "customer").selectExpr(
        "concat(2006 + c_custkey % 6 * 4, if(c_custkey % 4 = 0, ' FIFA Women World Cup', ' FIFA World Cup')) as tournament_name",
        "if(c_custkey % 11 = 0, 'Copa 2014', null) as other", "concat('N', c_nationkey) as team_name",
        "if(c_custkey % 5 = 0, null, concat('G', c_custkey % 17)) as given_name", "concat('F', c_custkey % 23) as family_name")
    raw = raw.withColumn("tournament_name", F.coalesce("other", "tournament_name"))
    return ratingfiles.squad_rows(raw, ["team_name"])


QUERIES = {f.__name__: f for f in (
    er_ratings_ladder, er_local_stats, er_player_id, er_profile, er_ratings_fuzzy, er_supplement, player_stat_preagg,
    er_club_stats, appearance_agg, starts_agg, build_club_stats, coverage_report, unmatched_players, team_aggregates, topk_team,
    coalesce_fallback, club_form_top11, team_line_power, matchup_features, rank_top11, top11_with_fallback, squads_to_ratings,
    clean_squad, squad_layout, standardize_ratings, squad_rows_by_year)}
