"""Queries over feature tables, evaluation, tuning, model fits and scoring."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions import poisson
from touchline.functions.numbers import to_number
from touchline.operators import bundle, dispersion, evaluate as ev, features, form, models, ratings, selections as sel, splits, squads
from touchline.operators.matchclean import match_flags, result_label
from touchline.operators.selection import exact_medians
from touchline.plans import carriers as c
from touchline.plans.common import show
from touchline.plans.markets import decisions, own_market, package_result, score_candidates
from touchline.plans.people import lineup
from touchline.plans.sources import latest_snapshots
from touchline.session import checkpoint_dir, cut_lineage

#: Ensemble sizes of the registered fits: boosting rounds, trees, and rounds of the score models.
ROUNDS, TREES, SCORE_ROUNDS = 140, 450, 300


def wide_frame(spark: SparkSession, folder: str) -> DataFrame:
    """A merged match table with text cells, an always-empty squad column and columns that are no features."""
    return c.table(spark, folder, "lineitem").selectExpr(
        f"{c.MATCH_ID} as match_id", "l_shipdate as date", "1 as result", "l_tax as unrelated",
        "case when l_linenumber = 7 then 'n/a' else cast(l_linenumber as string) end as closing_home_odds", "3.5 as closing_draw_odds",
        "l_linenumber / 2 as closing_handicap_line", "case when l_linenumber = 2 then '' else cast(l_linenumber % 3 as string) end as opening_handicap_line",
        "l_quantity as home_elo", "if(l_linestatus = 'O', 1, 0) as is_neutral", "case when l_quantity > 25 then l_discount end as h2h_draw_rate_10y",
        "cast(null as string) as home_squad_squad_top1_fc26", "l_suppkey as away_squad_squad_top1_fc26")


FRAME_FEATURES = ["closing_home_odds", "closing_draw_odds", "handicap_change", "home_elo", "is_neutral", "h2h_draw_rate_10y", "away_squad_squad_top1_fc26"]


def line_change(spark: SparkSession, folder: str) -> DataFrame:
    return show(features.line_changes(wide_frame(spark, folder)), ["match_id"], ["handicap_change"])


def feature_projection(spark: SparkSession, folder: str) -> DataFrame:
    out = features.feature_projection(wide_frame(spark, folder), ["match_id"])
    return show(out, ["match_id"], [n for n in out.columns if n != "match_id"])


def missing_audit(spark: SparkSession, folder: str) -> DataFrame:
    frame = features.line_changes(wide_frame(spark, folder)).withColumn("away_elo", F.lit(None).cast("double"))
    out = features.missing_audit(frame, [*FRAME_FEATURES, "away_elo"])
    return out.select("match_id", "missing_feature_count", F.array_join("missing_names", ",").alias("missing_features"), F.col("all_required_features_present").cast("int").alias("complete"))


MEDIAN = ["f_quantity", "f_price", "f_text"]


def median_frame(spark: SparkSession, folder: str) -> DataFrame:
    return c.table(spark, folder, "lineitem").selectExpr(
        f"{c.MATCH_ID} as match_id", "to_date(l_shipdate) as date", "case when l_linenumber < 6 then l_quantity end as f_quantity",
        "case when l_linenumber > 2 then l_extendedprice end as f_price", "if(l_linenumber = 3, 'x', cast(l_linenumber as string)) as f_text")


def train_slice_medians(spark: SparkSession, folder: str) -> DataFrame:
    rows = median_frame(spark, folder).withColumn("f_text", to_number("f_text"))
    train = splits.time_split(rows, ["date", "match_id"]).where("split_80_20 = 'train'")
    return exact_medians(train, MEDIAN)


def train_medians(spark: SparkSession, folder: str) -> DataFrame:
    return show(train_slice_medians(spark, folder), [], MEDIAN)


def impute_apply(spark: SparkSession, folder: str) -> DataFrame:
    medians = train_slice_medians(spark, folder).withColumn("f_absent", F.lit(None).cast("double"))
    return show(features.impute(median_frame(spark, folder), [*MEDIAN, "f_absent"], medians), ["match_id"], [*MEDIAN, "f_absent"])


DEFAULT_WEIGHTS = {"gbm": 0.45, "rf": 0.20, "logistic": 0.20, "poisson": 0.15}


def blended(spark: SparkSession, folder: str) -> DataFrame:
    out = ev.blend(ev.normalize(c.model_probabilities(spark, folder)), DEFAULT_WEIGHTS)
    return out.withColumn("prediction", ev.decide())


def blend(spark: SparkSession, folder: str) -> DataFrame:
    return show(blended(spark, folder), ["match_id"], ev.P)


def decide(spark: SparkSession, folder: str) -> DataFrame:
    return blended(spark, folder).select("match_id", "prediction", ev.decide(0.33).alias("with_threshold"))


def tune_weights(spark: SparkSession, folder: str) -> DataFrame:
    scores = ev.weight_scores(c.model_probabilities(spark, folder))
    # One row per candidate blend: ranking them takes one small task.
    order = W.orderBy(F.round("log_loss", 12), F.desc("accuracy"), F.round("brier", 12), "candidate")
    out = scores.withColumn("best", (F.row_number().over(order) == 1).cast("int"))
    return show(out, ["best"], [*[f"w_{m}" for m in ev.MODELS], "accuracy", "log_loss", "brier"])


def tune_threshold(spark: SparkSession, folder: str) -> DataFrame:
    scores = ev.threshold_scores(blended(spark, folder))
    best = ev.best_threshold(scores).select(F.coalesce("draw_threshold", F.lit(-1.0)).alias("t"))
    out = scores.join(best, F.coalesce("draw_threshold", F.lit(-1.0)) == F.col("t"), "left").withColumn("best", F.col("t").isNotNull().cast("int"))
    return show(out, ["best"], ["draw_threshold", "accuracy", "macro_f1", "draw_recall"], ["draw_predictions"])


METRICS = ["accuracy", "log_loss", "brier", "macro_f1"] + [f"{n}_{m}" for n in ("home", "draw", "away") for m in ("precision", "recall", "f1")]
CELLS = [f"c{t}{p}" for t in range(3) for p in range(3)]


def eval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return show(ev.metrics(blended(spark, folder)), [], METRICS, ["rows", *CELLS])


def eval_by_segment(spark: SparkSession, folder: str) -> DataFrame:
    return show(ev.by_segment(blended(spark, folder)), ["bucket"], ["accuracy", "draw_recall"], ["rows"])


def with_baseline(spark: SparkSession, folder: str) -> DataFrame:
    odds = c.market_matches(spark, folder).select("match_id", "home_odds", "draw_odds", "away_odds")
    return blended(spark, folder).join(odds, "match_id").withColumn("baseline", ev.odds_baseline(["home_odds", "draw_odds", "away_odds"]))


def baseline_odds(spark: SparkSession, folder: str) -> DataFrame:
    return c.market_matches(spark, folder).select("match_id", ev.odds_baseline(["home_odds", "draw_odds", "away_odds"]).alias("baseline"))


def confidence_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return show(ev.confidence_buckets(blended(spark, folder)), ["bucket"], ["hit_rate", "avg_confidence"], ["matches"])


def strategy_audit(spark: SparkSession, folder: str) -> DataFrame:
    out = ev.strategy_audit(with_baseline(spark, folder), "baseline").withColumn("beats_baseline", F.col("beats_baseline").cast("int"))
    return show(out, ["beats_baseline"], ["accuracy", "baseline_accuracy", "log_loss", "brier", "draw_recall", "draw_precision"], ["rows"])


def overfit_verdict(spark: SparkSession, folder: str) -> DataFrame:
    hit = lambda m: (ev.argmax([F.col(f"{m}_{i}") for i in range(3)]) == F.col("label")).cast("double")
    rows = c.model_probabilities(spark, folder).groupBy("tournament", F.year("date").alias("year")).agg(
        F.avg(hit("gbm")).alias("train"), F.avg(hit("rf")).alias("test"))
    return show(rows.withColumn("verdict", ev.overfit_verdict(F.col("train"), F.col("test"))), ["tournament", "year", "verdict"], ["train", "test"])


# Model fits. Training rows are the first 80 % by date, scored rows the last 20 %.
MODEL_FEATURES = ["home_elo", "away_elo", "elo_diff", "is_neutral", "is_world_cup", "is_friendly", "home_recent5_points_avg",
                  "away_recent5_points_avg", "recent5_points_avg_diff", "recent5_goal_diff_avg_diff"]


def model_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Features of both parts of the matches. Matches are split before anything is joined to them, as their order tells the parts."""
    rows = match_flags(c.matches(spark, folder)).withColumn("label", result_label())
    parts = splits.time_split(rows, ["date", "match_id"])
    return tuple(form.recent_form(ratings.elo_features(parts.where(f"split_80_20 = '{s}'"), c.ratings(spark, folder)), rows) for s in ("train", "test"))


@cache
def _fitted(path: str) -> set[str]:
    """The components that this application has fitted and saved at ``path``."""
    return set()


@cache
def _train(application: str, folder: str) -> DataFrame:
    """The columns of the training rows that are fitted to, stored."""
    return cut_lineage(model_rows(SparkSession.getActiveSession(), folder)[0].select(*MODEL_FEATURES, "label", "home_score", "away_score"))


def saved_models(spark: SparkSession, folder: str, parts: Sequence[str] = models.PARTS) -> bundle.Bundle:
    """The components of a folder's matches that a query scores with, each fitted once per application and saved where all
    executors see them."""
    name = hashlib.sha256(f"{folder}|{ROUNDS}|{TREES}".encode()).hexdigest()[:16]
    application = spark.sparkContext.applicationId
    path = f"{checkpoint_dir(spark).rstrip('/')}/touchline-models-{application}-{name}"
    missing = [p for p in parts if p not in _fitted(path)]
    if missing:
        train = _train(application, folder)
        fitted = bundle.fit(train, MODEL_FEATURES, exact_medians(train, MODEL_FEATURES), DEFAULT_WEIGHTS, ROUNDS, TREES, missing)
        fitted.save(path)
        _fitted(path).update(missing)
    return bundle.Bundle.load(spark, path, parts)


def scored_probabilities(df: DataFrame, prefix: str) -> DataFrame:
    return show(df, ["match_id"], [f"{prefix}_{i}" for i in range(3)])


def fit_gbm(spark: SparkSession, folder: str) -> DataFrame:
    models_, (_, test) = saved_models(spark, folder, ["gbm"]), model_rows(spark, folder)
    return scored_probabilities(models_.components.gbm.transform(models_.ready(test), "gbm"), "gbm")


def feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    models_ = saved_models(spark, folder, ["gbm"])
    rows = list(zip(models_.features, models_.components.gbm.importances(), strict=True))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"))


def fit_rf(spark: SparkSession, folder: str) -> DataFrame:
    models_, (_, test) = saved_models(spark, folder, ["rf"]), model_rows(spark, folder)
    return scored_probabilities(models.class_probabilities(models_.components.rf, models_.ready(test), "rf"), "rf")


def fit_logistic(spark: SparkSession, folder: str) -> DataFrame:
    models_, (_, test) = saved_models(spark, folder, ["logistic"]), model_rows(spark, folder)
    return scored_probabilities(models.class_probabilities(models_.components.logistic, models_.ready(test), "logistic"), "logistic")


def fit_poisson(spark: SparkSession, folder: str) -> DataFrame:
    models_, (_, test) = saved_models(spark, folder, ["goals"]), model_rows(spark, folder)
    out = models_.components.goals.transform(models_.ready(test), "poisson")
    return show(out, ["match_id"], ["home_lambda", "away_lambda", *[f"poisson_{i}" for i in range(3)]])


def fit_score_regression(spark: SparkSession, folder: str) -> DataFrame:
    rows = squads.matchup_features(c.matches(spark, folder), squads.line_power(lineup(spark, folder)))
    marked = splits.stratified_split(rows.withColumn("year", F.year("date")), ["match_id"], ["year"], 0.75, 42)
    model = models.fit_score_regression(marked.where("split = 'train'"), SCORE_ROUNDS)
    out = model.transform(models.assemble(marked.where("split = 'test'"), squads.MATCHUP))
    return models.score_errors(out)


def scored_components(spark: SparkSession, folder: str) -> DataFrame:
    models_, (_, test) = saved_models(spark, folder), model_rows(spark, folder)
    return models_.score(test).withColumn("prediction", ev.decide())


def fit_components(spark: SparkSession, folder: str) -> DataFrame:
    return ev.metrics(scored_components(spark, folder)).select("rows", "accuracy", "log_loss", "brier", "macro_f1")


def adjusted(df: DataFrame, floor: float) -> DataFrame:
    """Blend probabilities moved towards clearly stronger sides, with the pick."""
    none = F.lit(None).cast("double")
    df = df.withColumns({
        **dict(zip(sel.PROBS, [F.col(p) for p in ev.P])), "fifa_points_diff": none, "rating_diff": none,
        "home_value": F.col("home_elo"), "away_value": F.col("away_elo"),
        **{n: none for n in ("closing_home_odds", "closing_draw_odds", "closing_away_odds")}})
    return sel.strength_adjust(df, floor).withColumn("model_pick", models.model_pick(sel.PROBS))


def batch_score(spark: SparkSession, folder: str) -> DataFrame:
    """Latest fifth of the matches: blended, adjusted probabilities, the pick, and what the models had to fill in."""
    out = adjusted(scored_components(spark, folder), 0.001)
    return show(out, ["match_id", "model_pick", "model_source", "missing_features"], sel.PROBS, ["missing_feature_count"])


def match_score_serving(spark: SparkSession, folder: str) -> DataFrame:
    """The same with serving semantics: ratings of the match day count, pressure moves, the higher floor."""
    rows = match_flags(c.matches(spark, folder)).withColumn("label", result_label())
    rated = form.recent_form(ratings.elo_columns(ratings.dated_elo(rows, c.ratings(spark, folder), strict=False)))
    scored = saved_models(spark, folder).score(rated)
    pressure = c.market_matches(spark, folder).select("match_id", "home_pressure", "away_pressure")
    out = sel.motivation_adjust(adjusted(scored, 0.01).join(pressure, "match_id", "left"))
    return show(out.withColumn("model_pick", models.model_pick(sel.PROBS)), ["match_id", "model_pick", "model_source"], sel.PROBS)


def advice_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """1X2 and handicap candidates after mood, market signal and favourite guard."""
    games = c.market_matches(spark, folder, True)
    grid = poisson.with_goal_probabilities(games.select("match_id", "home_lambda", "away_lambda", "line"), "home_lambda", "away_lambda", 8)
    hand = poisson.handicap_probabilities(grid, "line").select("match_id", *[f"handicap_{s}" for s in ("home", "draw", "away")])
    # Matches are joined and their favourites found before the selections are listed.
    rows = c.selections_of(sel.with_favorite(own_market(games.join(hand, "match_id"))))
    own = F.when(F.col("pos") == 3, F.col("handicap_home")).when(F.col("pos") == 4, F.col("handicap_draw")).when(F.col("pos") == 5, F.col("handicap_away"))
    rows = rows.withColumn("probability", F.coalesce(F.when(own > 0, own), F.col("probability")))
    rows = sel.market_signal_adjust(sel.with_edge(sel.sentiment_adjust(rows)).withColumn("final_score", F.col("signal")))
    return sel.favorite_guard(rows).select(
        "day", "match_id", "pos", "pool", "selection", "probability", "odds", "expected_value", "kelly", "is_model_pick", "model_pick",
        F.col("market_signal_score").alias("signal"), F.col("market_favorite_conflict").alias("conflict"))


def daily_advice(spark: SparkSession, folder: str) -> DataFrame:
    """The four packages of every day."""
    wdl = advice_candidates(spark, folder)
    scores = score_candidates(spark, folder, True).select(
        "day", "match_id", "pos", "pool", "selection", "probability", "odds", "expected_value", "kelly", "is_model_pick", "model_pick",
        F.lit(0.0).alias("signal"), F.lit(False).alias("conflict"))
    parts = [sel.betting_package(wdl if name.startswith("wdl") else scores, rules, c.market_matches(spark, folder)).withColumn("package", F.lit(name))
             for name, rules in sel.PACKAGES.items()]
    return package_result(splits.combined(parts), ["package"])


def match_board(spark: SparkSession, folder: str) -> DataFrame:
    """One nested row per match: market picks, prices, probabilities and decision rows."""
    latest = latest_snapshots(spark, folder)
    priced = dispersion.normalized_probabilities(latest, ["match_id", "pool_code"])
    picks = dispersion.market_pick(latest, ["match_id", "pool_code"])
    # A pool has a handful of outcomes and a match a handful of pools: both lists are short.
    pools = priced.groupBy("match_id", "pool_code").agg(F.sort_array(F.collect_list(F.struct(
        F.round("odds", 6).alias("odds"), "outcome", F.round("probability", 6).alias("probability"), "handicap_line"))).alias("options"))
    board = pools.join(picks, ["match_id", "pool_code"]).groupBy("match_id").agg(
        F.sort_array(F.collect_list(F.struct("pool_code", "pick", "options"))).alias("pools"))
    graded = decisions(spark, folder).groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct(
        F.round(-F.col("final_score"), 6).alias("order"), "pool_code", "outcome", "grade"))).alias("decision"))
    return board.join(graded, "match_id", "left").select("match_id", F.to_json("pools").alias("pools"), F.to_json("decision").alias("decision"))


QUERIES = {f.__name__: f for f in (
    line_change, feature_projection, missing_audit, train_medians, impute_apply, blend, decide, tune_weights, tune_threshold,
    eval_metrics, eval_by_segment, baseline_odds, confidence_buckets, strategy_audit, overfit_verdict, fit_gbm,
    feature_importance, fit_rf, fit_logistic, fit_poisson, fit_score_regression, fit_components, batch_score,
    match_score_serving, daily_advice, match_board)}
