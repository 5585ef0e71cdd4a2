"""Near duplicates and components against brute force."""

import random

import pytest

from tests.llm.helpers import clashing, components, prose, shingle_set, table
from touchline.llm import minhash
from touchline.llm.components import components as spark_components


def brute(rows, threshold):
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and threshold[1] * len(sets[a] & sets[b]) >= threshold[0] * len(sets[a] | sets[b])]
    comp = components(sets, links)
    return {i: (len(s), comp[i], comp[i] == i) for i, s in sets.items()}


def varied(seed, groups=12, copies=12):
    """Groups of texts around a base, at similarities on both sides of the threshold."""
    rnd, texts = random.Random(seed), []
    for _ in range(groups):
        base = prose(rnd, rnd.randint(3, 120))
        for _ in range(rnd.randint(1, copies)):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**6)}"
            texts.append(" ".join(w.upper() if rnd.random() < 0.1 else w for w in words))
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("threshold", [(85, 100), (80, 100)])
def test_groups_equal_brute_force(spark, threshold):
    texts = [*varied(threshold[0]), "", " \n\t", "a", "A", "a b", "a b", "É", "é", "a b c d", "one two three four five"]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in
           minhash.near_duplicates(clashing(table(spark, texts)), "doc_id", "text", threshold).collect()}
    assert got == brute(list(enumerate(texts)), threshold)


def test_strangers_in_a_band_are_compared(spark, monkeypatch):
    """With one-row bands nearly all texts meet in some band, and blocks of two classes split every group."""
    monkeypatch.setattr(minhash, "BLOCK", 2)
    texts = varied(7, groups=3, copies=25)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in
           minhash.near_duplicates(table(spark, texts), "doc_id", "text", (85, 100), bands=20, rows=2).collect()}
    assert got == brute(list(enumerate(texts)), (85, 100))


def test_nulls_repeats_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = table(spark, [(0, text), (0, text), (5, text), (None, text), (None, "alone"), (7, None), (8, "x " * 50000)])
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in
                  minhash.near_duplicates(docs, "doc_id", "text").collect()), key=str)
    want = [(-1, 1, None, True), (-1, 26, 0, False), (-1, 26, 0, True), (-1, 26, 0, True), (5, 26, 0, False), (7, 0, 7, True), (8, 1, 8, True)]
    assert got == sorted(want, key=str)
    assert minhash.near_duplicates(docs.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    nodes = list(range(60))
    links = [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(rnd.choice([10, 40, 70]))]
    links += [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(1, 30)]
    want = components({x for link in links for x in link}, links)
    got = {r.node: r.component for r in spark_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: v for k, v in want.items() if k != v}


def test_no_links(spark):
    assert spark_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
