"""Goldens and properties of the as-of features."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.functions.dates import parse_mixed_dates
from touchline.operators import form, joins, ratings, standings
from touchline.operators.asof import as_of
from touchline.operators.headtohead import H2H_COLUMNS, head_to_head
from touchline.plans import carriers as c

D = dt.date
MATCH = "match_id string, date date, home_team string, away_team string, home_score int, away_score int"


def test_strict_as_of_and_ties(spark):
    state = spark.createDataFrame([("A", D(2020, 1, 1), 1.0, 1), ("A", D(2020, 1, 5), 2.0, 2), ("A", D(2020, 1, 5), 3.0, 3),
                                   ("A", D(2020, 1, 9), None, 4)], "team string, date date, elo double, seq int")
    probe = spark.createDataFrame([("A", D(2020, 1, d)) for d in (1, 2, 5, 6, 9, 10)] + [("B", D(2020, 1, 2)), ("A", None)], "team string, date date")
    got = {(r.team, r.date.day): r.elo for r in as_of(probe, state, ["team"], "date", ["elo"], ["seq"]).collect()}
    assert got == {("A", 1): None, ("A", 2): 1.0, ("A", 5): 1.0, ("A", 6): 3.0, ("A", 9): 3.0, ("A", 10): None, ("B", 2): None}
    got = {r.date.day: r.elo for r in as_of(probe, state, ["team"], "date", ["elo"], ["seq"], strict=False).where("team = 'A'").collect()}
    assert got[1] == 1.0 and got[5] == 3.0


def test_bucketed_as_of_equals_plain_on_a_hot_key(spark):
    rng = np.random.default_rng(3)
    times = pd.to_datetime("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 10_000, 2000)), unit="min")
    state = spark.createDataFrame(pd.DataFrame({"k": np.where(rng.random(2000) < .9, "hot", "x"), "at": times, "v": rng.normal(size=2000), "s": range(2000)}))
    probe = state.select("k", (F.col("at") + F.expr("interval 7 minutes")).alias("at"))
    for strict in (True, False):
        plain = as_of(probe, state, ["k"], "at", ["v"], ["s"], strict)
        bucketed = as_of(probe, state, ["k"], "at", ["v"], ["s"], strict, bucket=F.date_trunc("hour", "at"))
        assert sorted(map(str, plain.collect())) == sorted(map(str, bucketed.collect()))


def test_recent_form_golden(spark):
    rows = [(f"m{i}", D(2020, 1, i), "A", "B", i % 3, 1) for i in range(1, 8)] + [("same", D(2020, 1, 7), "C", "A", 0, 5)]
    out = {r.match_id: r for r in form.recent_form(spark.createDataFrame(rows, MATCH)).collect()}
    assert out["m1"].home_recent5_matches is None and out["m1"].recent5_matches_diff is None
    assert out["m3"].home_recent5_matches == 2
    last = out["m7"]  # A's results on days 2..6: 2-1, 0-1, 1-1, 2-1, 0-1; the other match of day 7 is not visible
    assert (last.home_recent5_matches, last.home_recent5_win_rate, last.home_recent5_draw_rate) == (5, 0.4, 0.2)
    assert last.home_recent5_points_avg == pytest.approx(7 / 5) and last.recent5_goal_diff_avg_diff == pytest.approx(0)
    assert out["same"].home_recent5_matches is None and out["same"].away_recent5_matches == 5


def test_head_to_head_window_edges(spark):
    rows = [("old", D(2010, 3, 1), "A", "B", 9, 0), ("edge", D(2010, 3, 2), "B", "A", 1, 0), ("draw", D(2015, 1, 1), "A", "B", 2, 2),
            ("now", D(2020, 3, 2), "A", "B", 0, 4), ("twin", D(2020, 3, 2), "B", "A", 0, 4), ("leap", D(2024, 2, 29), "A", "B", 0, 0)]
    out = {r.match_id: r for r in head_to_head(spark.createDataFrame(rows, MATCH)).collect()}
    now = out["now"]  # ten years back is inside, a day earlier and the same day are not
    assert [now[c_] for c_ in H2H_COLUMNS] == [2.0, 0.5, 0.0, 0.5, -0.5]
    twin = out["twin"]
    assert [twin[c_] for c_ in H2H_COLUMNS] == [2.0, 0.5, 0.5, 0.0, 0.5]
    assert out["old"].h2h_matches_10y is None and out["leap"].h2h_matches_10y == 3


def test_features_do_not_see_the_future(spark, small):
    matches = c.matches(spark, small).persist()
    cut = D(1998, 6, 1)
    changed = matches.withColumn("home_score", F.when(F.col("date") >= F.lit(cut), 99).otherwise(F.col("home_score")))
    rates = c.ratings(spark, small)
    moved = rates.withColumn("elo", F.when(F.col("date") >= F.lit(cut), -1.0).otherwise(F.col("elo")))

    def build(m, r):
        out = form.recent_form(ratings.elo_features(head_to_head(m), r)).where(F.col("date") <= F.lit(cut)).drop("home_score", "away_score")
        return sorted(map(str, out.select(sorted(out.columns)).collect()))

    assert build(matches, rates) == build(changed, moved)


def test_partitioning_does_not_matter(spark, small):
    matches = c.matches(spark, small)
    results = []
    for parts, shuffle in ((1, "1"), (13, "9")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        out = form.recent_form(matches.repartition(parts))
        results.append(sorted(map(str, out.select(sorted(out.columns)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_standings_tie_by_name_and_no_group(spark):
    schema = ("fixture_id int, date date, worldcup_group string, worldcup_matchday int, local_kickoff timestamp, home_team string, "
              "away_team string, home_score double, away_score double")
    t = lambda d, h=12: dt.datetime(2026, 6, d, h)
    rows = [(1, D(2026, 6, 1), "G", 1, t(1), "D", "C", 1.0, 1.0), (2, D(2026, 6, 1), "G", 1, t(1, 15), "A", "B", 2.0, 0.0),
            (3, D(2026, 6, 5), "G", 2, t(5), "A", "C", None, None), (4, D(2026, 6, 6), None, None, t(6), "X", "Y", None, None),
            (5, D(2026, 6, 9), "G", 3, None, "B", "D", None, None)]
    out = {r.fixture_id: r for r in standings.standings_before(spark.createDataFrame(rows, schema)).collect()}
    assert out[1].home_group_rank_before == 4 and out[1].away_group_rank_before == 3  # nothing played: by name
    assert out[2].group_known_prior_same_round_matches == 1
    assert (out[3].home_group_points_before, out[3].home_group_rank_before, out[3].away_group_rank_before) == (3, 1, 2)
    assert all(out[4][m] == 0 for m in standings.MOTIVATION)
    # Kickoff falls back to midnight of the day; B is last, two points and more behind the second.
    assert (out[5].home_group_rank_before, out[5].home_needs_win_flag, out[5].home_group_pressure) == (4, 1, pytest.approx(0.25 + 0.12 + 0.12 + 0.25))


def test_upsert_rejects_repeated_keys(spark):
    row = spark.createDataFrame([(D(2026, 1, 1), "A", "B", 1.0, 0.0)] * 2, "date date, home_team string, away_team string, home_score double, away_score double")
    with pytest.raises(ValueError):
        joins.upsert_results(row, row)


def test_mixed_dates(spark):
    texts = ["2025-08-10", "2025/8/9", "13/02/2020", "02/03/2020", "2025-08-10 12:30:00", "5 Mar 2020", "31/02/2020", "soon", "", None]
    got = [r.d for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(parse_mixed_dates("t").alias("d")).collect()]
    assert got == [D(2025, 8, 10), D(2025, 8, 9), D(2020, 2, 13), D(2020, 3, 2), D(2025, 8, 10), D(2020, 3, 5), None, None, None, None]
