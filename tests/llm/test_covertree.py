"""Cosine links against brute force."""

import random

import numpy as np
import pytest

from tests.llm.helpers import components
from touchline.llm import covertree


def brute(rows, least=0.98):
    sound = {}
    for i, v, label in rows:
        if label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            sound[i] = (label, np.array(v, float) / np.linalg.norm(np.array(v, float)))
    links = [(a, b) for a in sound for b in sound if a < b and sound[a][0] == sound[b][0]
             and len(sound[a][1]) == len(sound[b][1]) and sound[a][1] @ sound[b][1] >= least]
    comp = components([r[0] for r in rows], links)
    return {i: (sum(i in x for x in links), comp[i], comp[i] == i) for i, *_ in rows}


@pytest.mark.parametrize("block", [8, 512])
def test_links_equal_brute_force(spark, block):
    rnd = np.random.default_rng(4)
    rows = []
    for i in range(300):
        if rows and rnd.random() < 0.5:
            base = np.array(rows[rnd.integers(len(rows))][1]) + rnd.normal(size=6) * rnd.choice([0, 0.02, 0.1, 0.2])
        else:
            base = rnd.normal(size=6)
        rows.append((i, [float(x) for x in base * rnd.choice([1.0, 3.0])], int(rnd.integers(3))))
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 6, 1), (1003, [float("nan")] * 6, 1), (1004, [None] * 6, 1),
             (1005, rows[0][1], None), (1006, [float("inf")] + [0.0] * 5, 1), (1007, [1.0, 0.0], 1), (1008, [2.0, 0.0], 1)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").selectExpr("*", "1 as rep", "2 as node")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in
           covertree.cosine_links(df, "vec_id", "embedding", "label", 0.98, block).collect()}
    assert got == brute(rows)


def test_many_copies_and_empty(spark):
    rows = [(i, [1.0, 2.0], 1) for i in range(200)] + [(500, [2.0, 4.0], 1), (500, [2.0, 4.0], 1), (501, [-1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.cosine_links(df, "vec_id", "embedding", "label").collect()}
    assert got[0] == (200, 0) and got[199] == (200, 0) and got[500] == (200, 0) and got[501] == (0, 501)
    assert covertree.cosine_links(df.limit(0), "vec_id", "embedding", "label").count() == 0


def test_tree_covers():
    points = np.random.default_rng(0).normal(size=(200, 5))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    tree = covertree.Tree(points)
    for node in range(len(tree.centre)):
        far = np.linalg.norm(points[tree.below[node]] - points[tree.centre[node]], axis=1)
        assert far.max() <= tree.radius[node] + 1e-7
        if tree.last[node]:
            below = np.sort(np.concatenate([tree.below[c] for c in range(tree.first[node], tree.last[node])]))
            assert (below == np.sort(tree.below[node])).all()
