"""What queries leave on disk: rows that are shuffled or stored."""

import re

import pytest
from pyspark.sql import functions as F

from touchline.operators import models, selections as sel
from touchline.plans import carriers, markets, modeling


def shuffles(df):
    """The keys of a plan's shuffles."""
    return re.findall(r"Exchange (hash|range)partitioning\((.*)", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("rules", ["wdl_conservative", "wdl_aggressive"])
def test_packages_shuffle_matches_not_options(spark, small, monkeypatch, rules):
    """Options are chosen and placed where their matches were dealt to: one shuffle, below the list of selections."""
    stored = []
    cut = sel.cut_lineage
    monkeypatch.setattr(sel, "cut_lineage", lambda df: stored.append(df) or cut(df))
    out = sel.trim_to_cost(sel.package_options(markets.package_candidates(spark, small, True), sel.PACKAGES[rules]), sel.PACKAGES[rules])
    plan = stored[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.index("Generate inline") < plan.index("Exchange ")
    # A match is one stored row, and nothing after that shuffles by match.
    assert stored[0].count() == stored[0].select("day", "match_id").distinct().count()
    assert not [x for _, x in shuffles(out) if "match_id" in x.split("],")[0]]


def test_repeated_matches_are_one(spark, small):
    """Rows of a match that come twice are dealt to one place, as they were by a window."""
    rules = sel.PACKAGES["wdl_conservative"]

    def package(together):
        games = carriers.market_matches(spark, small, together)
        games = games.withColumn("_n", F.explode(F.when(F.xxhash64("match_id") % 9 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
        rows = sel.favorite_guard(carriers.selections_of(sel.with_favorite(markets.own_market(games)))).withColumnRenamed(
            "market_favorite_conflict", "conflict")
        return {tuple(r) for r in markets.package_result(sel.betting_package(rows, rules)).collect()}

    assert package(True) == package(False)


def test_parlay_rows_below_the_bound_are_not_shuffled(spark, small):
    """A day's bound is sent to the rows."""
    rows = markets.package_candidates(spark, small)
    plan = sel._near_best(rows, "day", 4)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_advice_joins_matches_before_they_are_listed(spark, small):
    rows = modeling.advice_candidates(spark, small)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Join") and len(shuffles(rows)) == 2


def test_a_total_passes_over_nulls(spark):
    rows = [("d", m, 0, "HAD", "主胜", 0.5, 2.0, v, None, True, "主胜", 0.0, False) for m, v in (("a", None), ("b", 0.25), ("c", 0.5))]
    schema = ("day string, match_id string, pos int, pool string, selection string, probability double, odds double, expected_value double, "
              "kelly double, is_model_pick boolean, model_pick string, signal double, conflict boolean")
    out = sel.betting_package(spark.createDataFrame(rows, schema), sel.PackageRules(0.1, 3, True, max_cost=50)).first()
    assert out.average_option_ev == pytest.approx(0.25) and out.average_kelly is None
    assert out.selected_count == 3 and out.matches == 3


def test_matches_are_split_before_they_are_joined(spark, small, monkeypatch):
    """The search for the split's borders joins nothing, joins by the away side share a shuffle, and what is stored is what is fitted to."""
    stored = []
    monkeypatch.setattr(modeling, "cut_lineage", lambda df: stored.append(df) or df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        modeling._train.__wrapped__("application", small)
        plan = stored[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert stored[0].columns == [*modeling.MODEL_FEATURES, "label", "home_score", "away_score"]
    # Two lookups for two sides, each reading its own history: 36 joins when the borders were searched among joined rows.
    assert plan.count("SortMergeJoin") <= 8


def test_a_slice_that_is_fitted_to_stays_off_the_disk(spark, monkeypatch):
    levels = []
    monkeypatch.setattr(models, "at_once", lambda *_: levels.append([r.storageLevel for r in kept]) or [None])
    kept, persist = [], type(spark.range(0)).persist
    monkeypatch.setattr(type(spark.range(0)), "persist", lambda df, *level: kept.append(persist(df, *level)) or kept[-1])
    models.fit_components(spark.createDataFrame([(0.0, 1)], "features double, label int"), parts=["rf"])
    assert [x.useDisk for x in levels[0]] == [False]
