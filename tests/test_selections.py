"""Packages against a step-by-step loop, and sinks."""

import random

import pytest

from touchline.functions import poisson
from touchline.operators.selections import PackageRules, betting_package, package_legs, package_options, parlay_plan
from touchline.sources import readers

SCHEMA = ("day string, match_id string, pos int, pool string, selection string, probability double, odds double, expected_value double, kelly double, "
          "is_model_pick boolean, model_pick string, signal double, conflict boolean")


def candidates(seed, days=6):
    rnd = random.Random(seed)
    rows = []
    for day in range(days):
        for match in range(rnd.randint(1, 7)):
            pick = rnd.choice(["主胜", "平局", "客胜"])
            for pos, sel in enumerate(["主胜", "平局", "客胜", "让胜", "让平", "让负"]):
                p, o = rnd.uniform(.1, .7), rnd.uniform(1.1, 4)
                rows.append((f"d{day}", f"m{match}", pos, "HAD" if pos < 3 else "HHAD 让球胜平负", sel, p, o, p * o - 1,
                             max(0.0, (p * o - 1) / (o - 1)), sel == pick, pick, rnd.choice([-.1, 0.0, .1]), rnd.random() < .1))
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("aggressive", [True, False])
def test_trimming_equals_the_loop(spark, seed, aggressive):
    rules = PackageRules(0.15, 3, aggressive, max_cost=20.0)
    df = spark.createDataFrame(candidates(seed), SCHEMA)
    groups = {}
    for r in package_options(df, rules).orderBy("day", "match_id", "_order").collect():
        groups.setdefault(r.day, {}).setdefault(r.match_id, []).append(r)
    want = {}
    for day, matches in groups.items():
        if len(matches) < 2:
            continue

        def tickets():
            out = 1
            for options in matches.values():
                out *= len(options)
            return out

        while tickets() * 2.0 > 20.0:
            weak = [(r.probability * r.odds * (2 if r._same else 1), m, i) for m, options in matches.items() if len(options) > 1
                    for i, r in enumerate(options) if not r.is_model_pick]
            if not weak:
                break
            _, m, i = min(weak)
            matches[m].pop(i)
        want[day] = (tickets(), sum(len(o) for o in matches.values()))
    rows = betting_package(df, rules).collect()
    got = {r.day: (round(r.bet_count), r.selected_count) for r in rows if r.matches >= 2}
    assert got == want
    # Every day has a row; what can't be played has a reason and no numbers.
    assert {r.day for r in rows} == {f"d{k}" for k in range(6)}
    for r in rows:
        if r.matches < 2:
            assert not r.available and r.reason and r.bet_count is None and r.play_type is None
        else:
            assert r.theoretical_max_prize == pytest.approx(r.max_combined_odds * rules.stake) and r.play_type == f"{r.matches}串1"
    legs = package_legs(df, rules).collect()
    assert {(r.day, r.match_id) for r in legs} == {(r[0], r[1]) for r in candidates(seed)}
    by = {(r.day, r.match_id): [o.pos for o in r.options] for r in legs}
    assert {k: len(v) for k, v in by.items() if v and k[0] in want} == {(d, m): len(o) for d, g in groups.items() if d in want for m, o in g.items()}
    assert {(r.day, r.skipped) for r in rows} == {(d, sum(not v for (x, _), v in by.items() if x == d)) for d in {k[0] for k in by}}


def test_threshold_search_with_equal_returns(spark):
    """All options of a day have one return, so one bucket decides; a day of many matches is cut at the right place."""
    rows = [("d", f"m{m:04d}", pos, "HAD", sel, 0.5, 2.0, 0.0, 0.0, pos == 0, "主胜", 0.0, False)
            for m in range(400) for pos, sel in enumerate(["主胜", "平局", "客胜"])]
    rules = PackageRules(0.15, 3, True, max_cost=80.0)
    out = betting_package(spark.createDataFrame(rows, SCHEMA), rules).first()
    # Tickets fall by 2/3, then 1/2 per match, in order of matches, until 40 or fewer are left.
    n, left = 3.0 ** 400, 1200
    for step in (2 / 3, 1 / 2) * 400:
        if n * 2.0 <= 80:
            break
        n, left = n * step, left - 1
    assert out.selected_count == left and out.total_cost == pytest.approx(n * 2.0)


def test_parlay_legs_and_days(spark):
    df = spark.createDataFrame(candidates(4), SCHEMA)
    rows = {r.day: r for r in parlay_plan(df, "day", max_legs=3).collect()}
    assert set(rows) == {f"d{k}" for k in range(6)}
    matches = {}
    for r in candidates(4):
        matches.setdefault(r[0], {}).setdefault(r[1], []).append(r)
    for day, games in matches.items():
        best = sorted((max((c for c in m if c[6] > 1), key=lambda c: (c[8], c[7], c[5], -c[2])) for m in games.values()),
                      key=lambda c: (-c[8], -c[7], -c[5], c[1]))[:3]
        got = rows[day]
        if len(best) < 2:
            assert not got.available and not got.legs and got.reason and got.combined_odds is None
        else:
            assert [(x.match_id, x.pos) for x in got.legs] == [(c[1], c[2]) for c in best] and got.play_type == f"{len(best)}串1"
    picks = parlay_plan(df, "day", require_model_pick=True).collect()
    assert all(leg.is_model_pick for r in picks for leg in r.legs)


def test_grid_sums_to_one(spark):
    df = spark.createDataFrame([(0.0, 2.0, -1.0), (1.4, 1.4, 0.5), (6.0, 0.05, 0.0)], "h double, a double, line double")
    for r in poisson.outcome_probabilities(poisson.with_goal_probabilities(df, "h", "a")).collect():
        assert r.home_win_prob + r.draw_prob + r.away_win_prob == pytest.approx(1)
    for r in poisson.handicap_probabilities(poisson.with_goal_probabilities(df, "h", "a", 8), "line").collect():
        assert r.handicap_home + r.handicap_draw + r.handicap_away == pytest.approx(1)
        assert (r.handicap_draw > 1e-9) == (r.line == int(r.line))
    none = poisson.handicap_probabilities(poisson.with_goal_probabilities(df.selectExpr("h", "a", "cast(null as double) as line"), "h", "a", 8), "line").first()
    assert none.handicap_home is None and none.handicap_draw is None


def test_top_scores_equal_the_sorted_grid(spark):
    """Also where many scores are equal at 12 digits, and for any number of scores."""
    rnd = random.Random(5)
    rates = [(rnd.choice([0.0, 1e-5, 1.0, 2.0, rnd.uniform(0, 7)]), rnd.choice([0.0, 1e-4, 1.0, 3.0, 400.0, rnd.uniform(0, 7)])) for _ in range(300)]
    df = spark.createDataFrame([(i, float(h), float(a)) for i, (h, a) in enumerate(rates)], "id int, h double, a double")
    grid = poisson.with_goal_probabilities(df, "h", "a")
    for n in (1, 8, 49, 60):
        out = poisson.with_top_scores(grid, n)
        assert out.columns == [*grid.columns, "top_scores"]
        for r in out.collect():
            cells = [(i, j, r[f"_h{i}"] * r[f"_a{j}"]) for i in range(7) for j in range(7)]
            cells.sort(key=lambda c: (-round(c[2] * 1e12), c[0], c[1]))
            assert [(s.score, s.probability) for s in r.top_scores] == [(f"{i}-{j}", p) for i, j, p in cells[:n]]


def test_csv_scan_keeps_file_names(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿match_id,home_team\n1,Curaçao\n".encode())
    (tmp_path / "b.csv").write_text("match_id,home_team\n2,Peru\n", encoding="utf-8")
    out = readers.scan_csv_files(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "match_id int, home_team string")
    assert sorted((r.match_id, r.home_team, r.source_file) for r in out.collect()) == [(1, "Curaçao", "a.csv"), (2, "Peru", "b.csv")]
    (tmp_path / "c.csv").write_bytes("match_id,home_team\n3,Curaçao\n".encode("latin1"))
    assert readers.scan_csv(spark, str(tmp_path / "c.csv"), "match_id int, home_team string", "ISO-8859-1").first().home_team == "Curaçao"


def test_the_favourite_is_found_once_per_match(spark, small):
    """Filters on guarded selections do not find it again: its odds limit is in the plan once."""
    from touchline.plans.markets import package_candidates

    plan = package_candidates(spark, small).where("probability > 0.15 and not conflict and expected_value > 0")
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("<= 1.45") == 1


def test_options_are_placed_without_a_second_shuffle(spark, tmp_path, monkeypatch):
    """What trimming stores holds the options' places already."""
    from touchline.operators import selections

    stored = []
    monkeypatch.setattr(selections, "cut_lineage", lambda df: stored.append(df.columns) or df)
    package_legs(spark.createDataFrame(candidates(1), SCHEMA), PackageRules(0.15, 3, False, max_cost=50)).collect()
    assert len(stored) == 1 and {"_n", "_log", "_bucket"} <= set(stored[0])
