"""Queries over market snapshots, trades, fixtures, score grids and selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import poisson
from touchline.operators import dispersion, fixtures as fx, market, selections as sel
from touchline.plans import carriers as c
from touchline.plans.common import r6, show
from touchline.plans.sources import latest_snapshots, market_rows
from touchline.sources.tables import table


def half_snapshots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The newest odds per key of the second and of the first half of the month."""
    rows = c.snapshots(spark, folder)
    latest = lambda d: market.keep_one(d, market.ODDS_KEY, ["fetched_at"], "last")
    return latest(rows.where("fetched_at >= '2024-01-16'")), latest(rows.where("fetched_at < '2024-01-16'"))


CHANGE = ["odds", "previous_odds", "odds_change", "odds_change_pct"]


def snapshot_diff(spark: SparkSession, folder: str) -> DataFrame:
    return show(market.snapshot_diff(*half_snapshots(spark, folder)), market.ODDS_KEY, CHANGE)


def largest_moves(spark: SparkSession, folder: str) -> DataFrame:
    changes = market.snapshot_diff(*half_snapshots(spark, folder))
    return show(market.largest_first(changes, "odds_change", *market.ODDS_KEY), market.ODDS_KEY, ["odds_change"])


def stream_odds_changes(spark: SparkSession, folder: str) -> DataFrame:
    return show(market.successive_changes(c.snapshots(spark, folder)), ["event_id", *market.ODDS_KEY], CHANGE)


def asof_lag_odds(spark: SparkSession, folder: str) -> DataFrame:
    rows = c.snapshots(spark, folder)
    out = rows.join(market.lagged_odds(rows, rows), [*market.ODDS_KEY, "fetched_at"], "left")
    return show(out, ["event_id"], ["odds", "prior_10", "prior_30", "prior_120"])


def odds_move_score(spark: SparkSession, folder: str) -> DataFrame:
    change = F.expr("(event_id % 61 - 30) / 200 + value / 100000")
    return table(spark, folder, "events").select("event_id", r6(market.move_score(change), "score"))


def outcome_model(spark: SparkSession, folder: str) -> DataFrame:
    """Model probability of every (match, pool, outcome)."""
    n = "cast(substr(match_id, 2) as int)"
    rows = c.snapshots(spark, folder).selectExpr("match_id", f"{n} as n").distinct().selectExpr(
        "match_id", "cast(1 + n % 5 as double) as a", "cast(1 + n % 3 as double) as b", "cast(1 + n % 7 as double) as d")
    parts = {("had", "home_win"): "a", ("had", "draw"): "b", ("had", "away_win"): "d",
             ("hhad", "home_win"): "b", ("hhad", "draw"): "d", ("hhad", "away_win"): "a"}
    total = F.col("a") + F.col("b") + F.col("d")
    return rows.select("match_id", F.inline(F.array(*[
        F.struct(F.lit(pool).alias("pool_code"), F.lit(o).alias("outcome"), (F.col(v) / total).alias("model_probability"))
        for (pool, o), v in parts.items()])))


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    current = market.with_now(latest_snapshots(spark, folder))
    return market.market_decision(current, c.snapshots(spark, folder), outcome_model(spark, folder))


def market_decision(spark: SparkSession, folder: str) -> DataFrame:
    return show(decisions(spark, folder), [*market.ODDS_KEY, "grade"], [
        "odds", "model_probability", "market_probability", "value_edge", "odds_change_10m", "odds_change_30m",
        "odds_change_120m", "momentum_score", "value_score", "final_score"])


def edge_report(spark: SparkSession, folder: str) -> DataFrame:
    predictions = table(spark, folder, "part").selectExpr(
        "p_partkey", "concat(' t', p_partkey % 60) as subject",
        "element_at(array('tournament_winner', 'advance_or_qualify', 'match_related'), cast(p_size % 3 as int) + 1) as signal_type",
        "if(p_size % 10 = 0, '', cast(p_size / 64 as string)) as model_probability")
    signals = dispersion.yes_no_signals(market_rows(spark, folder)).where("subject <> ''")
    out = market.edge_report(predictions, signals)
    return show(out, ["p_partkey", "market_id"], ["model_probability", "market_probability", "edge"])


def stream_large_buys(spark: SparkSession, folder: str) -> DataFrame:
    return show(market.large_buys(c.trades(spark, folder)), ["trade_id", "side"], ["notional", "size", "price"])


def event_games(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "concat_ws('/', user_id % 100, get_json_object(props, '$.k'), date_format(ts, 'yyyy-MM-dd')) as match_key",
        "to_date(ts) as date", "concat('T', user_id % 100) as home_team", "concat('T', get_json_object(props, '$.k')) as away_team")


def trade_to_match(spark: SparkSession, folder: str) -> DataFrame:
    out = market.attribute_trades(c.trades(spark, folder).dropDuplicates(["trade_id"]), event_games(spark, folder))
    return out.select("trade_id", "match_key")


def match_large_buys(spark: SparkSession, folder: str) -> DataFrame:
    out = market.attribute_trades(market.large_buys(c.trades(spark, folder)), event_games(spark, folder))
    return show(out, ["trade_id", "match_key"], ["notional"])


def signal_attach(spark: SparkSession, folder: str) -> DataFrame:
    had = F.col("pool_code") == "had"
    name = lambda table_: F.try_element_at(F.create_map(*[F.lit(x) for p in table_.items() for x in p]), "outcome")
    rows = latest_snapshots(spark, folder)
    candidates = rows.select(
        "match_id", "outcome", F.when(had, sel.HAD).otherwise(sel.HHAD).alias("pool"),
        F.when(had, name({"home_win": "主胜", "draw": "平局", "away_win": "客胜"}))
        .otherwise(name({"home_win": "让胜(-1)", "draw": "让平(-1)", "away_win": "让负(-1)"})).alias("selection"))
    signals = c.snapshots(spark, folder).select(
        "match_id", "pool_code", "event_id", F.col("odds").alias("final_score"), F.lit("x").alias("grade"),
        F.when(had, name({"home_win": " 主胜", "draw": "平", "away_win": "客胜!"}))
        .otherwise(name({"home_win": "让胜", "draw": "让平(+2)", "away_win": "让负"})).alias("selection"))
    return show(market.attach_signal(candidates, signals, "event_id"), ["match_id", "pool", "selection"], ["final_score"])


def crs_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "l_orderkey as match_id", f"{c.MATCH_ID} as seq",
        "if(l_partkey % 9 = 0, 'home_other', concat(cast(l_quantity as int) % 4, '-', l_linenumber % 3)) as outcome",
        "l_extendedprice / 5000 + l_tax as odds")


def crs_implied(spark: SparkSession, folder: str) -> DataFrame:
    return show(dispersion.score_implied(crs_rows(spark, folder), ["match_id"]), ["match_id"], ["home_prob", "draw_prob", "away_prob"])


def shortest_odds(spark: SparkSession, folder: str) -> DataFrame:
    out = dispersion.shortest_odds(crs_rows(spark, folder).withColumn("outcome", F.concat_ws("#", "outcome", "seq")), ["match_id"], 3)
    return show(out, ["match_id", "outcome"], ["odds"], ["position"])


def pool_board(spark: SparkSession, folder: str) -> DataFrame:
    """Pools of each match in fixed order, outcomes by price, as one text per pool."""
    rows = latest_snapshots(spark, folder).withColumn(
        "place", F.array_position(F.array(*[F.lit(x) for x in ("had", "hhad", "ttg", "hafu", "crs")]), F.col("pool_code")))
    options = F.sort_array(F.collect_list(F.struct("odds", "outcome")))  # at most one entry per outcome
    return rows.groupBy("match_id", "pool_code", "place").agg(options.alias("o")).select(
        "match_id", "pool_code", "place", F.array_join(F.transform("o", lambda x: x.outcome), ",").alias("options"))


def pivot_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    rows = c.bookmaker_odds(spark, folder).withColumn("date", F.to_date("commence_time"))
    out = dispersion.pivot_first(rows, ["date", "home_team", "away_team"], "seq", {"home": "home_odds", "draw": "draw_odds", "away": "away_odds"})
    return show(out, ["date", "home_team", "away_team"], ["home_odds", "draw_odds", "away_odds"])


def live_odds_overlay(spark: SparkSession, folder: str) -> DataFrame:
    rows = c.fixtures(spark, folder).select("fixture_id", "date", "home_team", "away_team").withColumns({
        n: F.expr(f"case when fixture_id % 4 = 0 then {v} + fixture_id % 10 / 10 end")
        for n, v in zip(fx.CLOSING, ("1.5D", "3.1D", "2.2D"))})
    listed = rows.selectExpr("fixture_id", "date_add(date, cast(fixture_id % 2 as int)) as date", "home_team", "away_team")
    # Each source names the games of the other, and a third of all, differently.
    had = listed.selectExpr(
        "fixture_id as seq", "date", "if(fixture_id % 3 = 0, home_team, concat('X', home_team)) as home_team", "away_team",
        "inline(array(struct('home_win' as outcome, 1.2D + fixture_id % 30 / 10 as odds), struct('draw' as outcome, 3.0D + fixture_id % 7 / 10 as odds), "
        "struct(if(fixture_id % 15 = 0, 'none', 'away_win') as outcome, 2.0D + fixture_id % 11 / 10 as odds)))")
    scores = listed.selectExpr(
        "date", "if(fixture_id % 3 = 1, home_team, concat('X', home_team)) as home_team", "away_team",
        "inline(array(struct('1-0' as outcome, 5.0D + fixture_id % 9 as odds), struct('0-0' as outcome, 7.0D as odds), struct('0-2' as outcome, 9.0D + fixture_id % 4 as odds), "
        "struct('home_other' as outcome, 2.0D as odds)))")
    return show(fx.live_odds_overlay(rows, had, scores, "seq"), ["fixture_id", "odds_source"], fx.CLOSING)


def schedule_join(spark: SparkSession, folder: str) -> DataFrame:
    rows = c.fixtures(spark, folder).select("fixture_id", "date", "home_team", "away_team")
    nation = table(spark, folder, "nation")
    games = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.expr("o_custkey = c_custkey")).selectExpr(
        "o_orderkey as id", "if(o_orderkey % 2 = 0, c_nationkey, (c_nationkey + 5) % 25) as home_team_id",
        "if(o_orderkey % 2 = 0, (c_nationkey + 5) % 25, c_nationkey) as away_team_id",
        "concat('G', c_nationkey % 5) as `group`", "cast(o_orderkey % 3 + 1 as int) as matchday",
        # A third of the games lies far off any fixture.
        "date_format(date_add(o_orderdate, cast(o_orderkey % 5 = 0 as int) + if(o_orderkey % 3 = 0, 9000, 0)), 'MM/dd/yyyy 18:30') as local_date",
        "if(o_orderkey % 7 = 0, 'tba', date_format(date_add(o_orderdate, cast(o_orderkey % 5 = 0 as int) + 1), 'yyyy-MM-dd') || 'T02:30:00Z') as date",
        "if(o_orderkey % 4 = 0, 'knockout', 'group') as type", "o_custkey % 100 as stadium_id")
    teams = nation.selectExpr("n_nationkey as id", "concat(n_name, ' ') as name_en", "concat('F', n_nationkey) as fifa_code")
    stadia = table(spark, folder, "supplier").join(nation, F.expr("s_nationkey = n_nationkey")).selectExpr(
        "s_suppkey as id", "s_name as name_en", "n_name as country_en", "concat('FIFA ', s_name) as fifa_name", "concat('C', s_suppkey % 11) as city_en",
        "cast(floor(abs(s_acctbal)) as bigint) as capacity", "concat('R', n_regionkey) as region")
    out = fx.schedule_metadata(rows, games, teams, stadia).withColumn("utc", F.date_format("utc_kickoff", "yyyy-MM-dd HH:mm"))
    return show(out, ["fixture_id", "worldcup_match_type", "utc", "stadium_fifa_name", "stadium_city", "stadium_region", "worldcup_group", "home_fifa_code", "stadium_name"], [],
                ["stadium_id", "stadium_capacity", "repo_match_id", "repo_home_away_swapped", "is_home_host_country", "is_host_country_match", "kickoff_hour_local"])


def fixture_requests(spark: SparkSession, folder: str) -> DataFrame:
    return c.fixtures(spark, folder).selectExpr(
        "fixture_id as request_id", "date_add(date, cast(fixture_id % 3 as int)) as date",
        "if(fixture_id % 4 = 0, away_team, home_team) as home_team", "if(fixture_id % 4 = 0, home_team, away_team) as away_team")


def fixture_lookup(spark: SparkSession, folder: str) -> DataFrame:
    # Every fifth fixture is listed under another name, so its request finds none.
    table_ = c.fixtures(spark, folder).withColumn("home_team", F.expr("if(fixture_id % 5 = 0, concat('X', home_team), home_team)"))
    out = fx.fixture_lookup(fixture_requests(spark, folder), table_, "fixture_id")
    return show(out.withColumn("available", F.col("available").cast("int")), ["request_id"], [], ["fixture_id", "swapped", "available"])


def listed_matches(spark: SparkSession, folder: str) -> DataFrame:
    return fixture_requests(spark, folder).selectExpr("date_add(date, 1) as day", "request_id as match_id", "home_team", "away_team")


def unlisted_fixtures(spark: SparkSession, folder: str) -> DataFrame:
    out = fx.unlisted_fixtures(c.fixtures(spark, folder), listed_matches(spark, folder))
    return show(out, ["day", "fixture_id"], [])


def open_match_count(spark: SparkSession, folder: str) -> DataFrame:
    out = fx.open_match_count(c.fixtures(spark, folder), listed_matches(spark, folder))
    return show(out, ["day", "next_day"], [], ["scheduled", "open"])


def poisson_grid(spark: SparkSession, folder: str) -> DataFrame:
    grid = poisson.with_goal_probabilities(c.goal_rates(spark, folder), "home_lambda", "away_lambda")
    return show(poisson.outcome_probabilities(grid), ["match_id", "pick"], ["home_win_prob", "draw_prob", "away_win_prob"])


def top_exact_scores(spark: SparkSession, folder: str) -> DataFrame:
    grid = poisson.with_goal_probabilities(c.goal_rates(spark, folder), "home_lambda", "away_lambda")
    out = poisson.with_top_scores(grid, 8, "s")
    return out.select("match_id", F.array_join(F.transform("s", lambda x: x.score), " ").alias("scores"),
                      r6(F.aggregate("s", F.lit(0.0), lambda a, x: a + x.probability), "covered"))


def poisson_handicap(spark: SparkSession, folder: str) -> DataFrame:
    grid = poisson.with_goal_probabilities(c.goal_rates(spark, folder), "home_lambda", "away_lambda", 8)
    return show(poisson.handicap_probabilities(grid, "handicap_line"), ["match_id"], ["handicap_home", "handicap_draw", "handicap_away"])


def selection_edge(spark: SparkSession, folder: str) -> DataFrame:
    return show(sel.with_edge(c.selections(spark, folder)), ["match_id", "selection"], ["probability", "odds", "expected_value", "kelly"])


def strength_adjust(spark: SparkSession, folder: str) -> DataFrame:
    return show(sel.strength_adjust(c.market_matches(spark, folder)), ["match_id"], sel.PROBS)


def motivation_adjust(spark: SparkSession, folder: str) -> DataFrame:
    return show(sel.motivation_adjust(c.market_matches(spark, folder)), ["match_id"], sel.PROBS)


def sentiment_diff(spark: SparkSession, folder: str) -> DataFrame:
    mood = c.static_ratings(spark, folder).where("elo > 0").groupBy("team").agg(
        (F.max("elo") / 1500 - 3).alias("overall"), (F.max("seq") % 10 / 10).alias("confidence"))
    return show(sel.sentiment_difference(c.matches(spark, folder), mood), ["match_id"], ["sentiment_diff"])


def sentiment_adjust(spark: SparkSession, folder: str) -> DataFrame:
    return show(sel.sentiment_adjust(c.selections(spark, folder)), ["match_id", "selection"], ["probability"])


def market_signal_adjust(spark: SparkSession, folder: str) -> DataFrame:
    rows = c.selections(spark, folder).withColumn("final_score", F.when(F.expr("l_suppkey % 3 > 0"), F.col("signal") * 2))
    return show(sel.market_signal_adjust(rows), ["match_id", "selection"], ["probability", "expected_value", "kelly", "market_signal_score"])


def own_market(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        **{f"had_{s}_prob": F.col(f"{s}_prob") for s in ("home", "draw", "away")},
        **{f"had_{s}_odds": F.col(f"{s}_odds") for s in ("home", "draw", "away")}})


def guarded_selections(spark: SparkSession, folder: str, together: bool = False) -> DataFrame:
    """All selections, guarded; the favourite is found once per match, before its selections are listed."""
    return sel.favorite_guard(c.selections_of(sel.with_favorite(own_market(c.market_matches(spark, folder, together)))))


def favorite_guard(spark: SparkSession, folder: str) -> DataFrame:
    out = guarded_selections(spark, folder)
    return out.select(
        "match_id", "selection", F.col("market_favorite_conflict").cast("int").alias("conflict"), r6("probability"), r6("expected_value"))


def score_candidates(spark: SparkSession, folder: str, together: bool = False) -> DataFrame:
    games = c.market_matches(spark, folder, together).select(
        "match_id", "day", *sel.PROBS, "model_pick", "home_lambda", "away_lambda", "l_partkey", "l_linenumber")
    grid = poisson.with_top_scores(poisson.with_goal_probabilities(games, "home_lambda", "away_lambda"), 8)
    grid = poisson.without_goals(grid).withColumn("top_scores", F.when(F.col("l_linenumber") < 7, F.col("top_scores")))
    return sel.exact_score_candidates(c.listed_scores(grid))


def exact_score_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return score_candidates(spark, folder).groupBy("match_id").agg(
        F.count("*").alias("candidates"), F.count_if("is_model_pick").alias("picks"),
        r6(F.sum("probability"), "probability"), r6(F.max("expected_value"), "best_value"), r6(F.sum("kelly"), "kelly"))


def package_candidates(spark: SparkSession, folder: str, together: bool = False) -> DataFrame:
    rows = guarded_selections(spark, folder, together).withColumnRenamed("market_favorite_conflict", "conflict")
    return rows.select("day", "match_id", "pos", "pool", "selection", "probability", "odds", "expected_value", "kelly",
                       "is_model_pick", "model_pick", "signal", "conflict")


def legs_text(legs: Column, *fields: str) -> Column:
    """Legs as comparable text."""
    return F.array_join(F.transform(legs, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), ",")


def parlay_plan(spark: SparkSession, folder: str) -> DataFrame:
    out = sel.parlay_plan(package_candidates(spark, folder), "day").withColumns(
        {"available": F.col("available").cast("int"), "leg_count": F.size("legs"), "legs": legs_text(F.col("legs"), "match_id", "pos", "selection")})
    return show(out, ["day", "available", "reason", "play_type", "legs"],
                ["combined_odds", "combined_probability", "expected_value", "full_kelly", "stake_fraction"], ["leg_count"])


def parlay_plan_model_picks(spark: SparkSession, folder: str) -> DataFrame:
    """Two legs, model picks only."""
    out = sel.parlay_plan(package_candidates(spark, folder), "day", 2, min_probability=0.3, require_model_pick=True)
    out = out.withColumns({"available": F.col("available").cast("int"), "legs": legs_text(F.col("legs"), "match_id", "pos")})
    return show(out, ["day", "available", "reason", "legs"], ["combined_odds", "stake_fraction"])


def package_result(out: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Comparable package columns; the large products as logarithms."""
    logs = {f"log_{n}": F.ln(n) for n in ("total_cost", "min_combined_odds", "max_combined_odds", "bet_count", "package_hit_probability",
                                          "theoretical_max_prize")}
    out = out.withColumns(logs).withColumn("available", F.col("available").cast("int"))
    return out.select(F.col("day").cast("string").alias("day"), *keys, "available", "reason", "play_type", *[r6(n) for n in logs],
                      r6("average_kelly"), r6("average_option_ev"),
                      *[F.col(n).cast("bigint").alias(n) for n in ("matches", "skipped", "selected_count")])


def betting_package(spark: SparkSession, folder: str) -> DataFrame:
    """The conservative 1X2/handicap package of every day."""
    return package_result(sel.betting_package(
        package_candidates(spark, folder, True), sel.PACKAGES["wdl_conservative"], c.market_matches(spark, folder)))


def betting_package_aggressive(spark: SparkSession, folder: str) -> DataFrame:
    return package_result(sel.betting_package(
        package_candidates(spark, folder, True), sel.PACKAGES["wdl_aggressive"], c.market_matches(spark, folder)))


def package_legs(spark: SparkSession, folder: str) -> DataFrame:
    """The options that the conservative package plays of every match, in order; none for a skipped match."""
    out = sel.package_legs(package_candidates(spark, folder, True), sel.PACKAGES["wdl_conservative"], c.market_matches(spark, folder))
    return out.select(F.col("day").cast("string").alias("day"), "match_id", F.size("options").alias("n"),
                      legs_text(F.col("options"), "pos", "selection").alias("options"))


QUERIES = {f.__name__: f for f in (
    snapshot_diff, largest_moves, stream_odds_changes, asof_lag_odds, odds_move_score, market_decision, edge_report,
    stream_large_buys, trade_to_match, match_large_buys, signal_attach, crs_implied, shortest_odds, pool_board, pivot_outcomes,
    live_odds_overlay, schedule_join, fixture_lookup, unlisted_fixtures, open_match_count, poisson_grid, top_exact_scores,
    poisson_handicap, selection_edge, strength_adjust, motivation_adjust, sentiment_diff, sentiment_adjust,
    market_signal_adjust, favorite_guard, exact_score_candidates, parlay_plan, parlay_plan_model_picks, betting_package, betting_package_aggressive,
    package_legs)}
