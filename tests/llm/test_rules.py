"""Quality rules: counts against plain Python, the learner on planted rules, odd rows, clean documents."""

import random
from collections import Counter

import numpy as np

from tests.llm.helpers import SCHEMA, WORD, clashing
from touchline.llm import rules
from touchline.llm.queries import QUERIES

LABELS = "doc_id bigint, quality int, toxic int"


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k + j for k in range(len(w) - 2) if windows[tuple(w[k:k + 3])] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_counts(spark):
    rnd = random.Random(5)
    signs = ["a", "A", "b", "é", "語", "\U0001F600", " ", " ", "\n", "\n", "\t", "\r", "\x0b", " ", "#", "|", "<", "!", "7"]
    texts = [None, "", " \n\t", "a", "a b c a b c", "a a a a", "x\n x\nx\n\n\nx", "|" * 3000, "a b c\nd e f\na b c"]
    texts += ["".join(rnd.choice(signs) for _ in range(rnd.randrange(300))) for _ in range(300)]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(90))) for _ in range(60)]
    texts += ["the line says it all\n" * 60000, "x" * 1_200_000, " ".join(str(k) for k in range(90000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:6] for r in rules.counted(df, "doc_id", "text").collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain(t), (i, (t or "")[:60])


def test_learner_finds_planted_rules():
    rnd = np.random.default_rng(0)
    values = {name: rnd.random(6000) for name in list(rules.FEATURES)[:4]}
    a, b, c, _ = values.values()
    bad = ((a > 0.8) & (b < 0.5)) | (c > 0.95)
    found = rules.learn(values, bad)
    told = np.zeros(len(bad), bool)
    for rule in found.rules:
        told |= rules._covered(rule, values)
    assert (told == bad).mean() > 0.99
    assert str(found).count("bad") == len(found.rules) <= 8 and str(found).endswith("else good")
    # Without a pattern no rule is right often enough to stay.
    assert rules.learn(values, rnd.random(6000) < 0.3).rules == ()
    assert rules.learn(values, np.zeros(6000, bool)).rules == ()


def test_pruning_cuts_what_only_fits_the_grown_rows():
    values = {"words": np.array([1.0, 2, 3, 4]), "word length": np.array([1.0, 1, 2, 2])}
    rule = (rules.Condition("words", True, 2.5), rules.Condition("word length", False, 1.5))
    assert rules.prune(rule, values, np.array([False, False, True, True]), np.ones(4)) == rule[:1]


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op11_quality_rules"](spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r)[1:6] == plain(docs[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.rule == 0)
    passed = {r.doc_id: r.kept for r in rows if not r.base_failed}
    labels = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.doc_id in passed]
    assert np.mean([passed[r.doc_id] for r in labels if r.quality == 1]) > 0.99
    assert np.mean([passed[r.doc_id] for r in labels if r.quality == 0]) < 0.15


def test_odd_rows(spark):
    good, junk = "a plain text of some words that says little and goes on {} " * 5, "$$$ ### {} x! " * 30
    rows = [(i, (good if i % 3 else junk).format(*[f"w{i * 40 + k}" for k in range(30)]), "en", "s", 1) for i in range(90)]
    rows += [(None, rows[0][1], "en", "s", 1), (5, rows[5][1], None, None, None), (900, None, "en", "s", 1), (901, "", "en", "s", 1)]
    df = clashing(spark.createDataFrame(rows, SCHEMA)).withColumnsRenamed({"lang": "n_words", "source": "_text"})
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)] + [(1, 1, 0), (2, None, 0), (None, 0, 0)], LABELS)
    got = rules.judged(df, labels, "doc_id", "text", "doc_id", "quality").collect()
    assert len(got) == len(rows)
    empty = [r for r in got if r.doc_id in (900, 901)]
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in empty)
    unlabelled = rules.judged(df, labels.limit(0), "doc_id", "text", "doc_id", "quality").collect()
    assert all(r.kept == (not r.base_failed) for r in unlabelled)
    assert rules.judged(df.limit(0), labels, "doc_id", "text", "doc_id", "quality").count() == 0


def test_bounded_sample_keeps_both_classes(spark):
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(i, long + (" $$$ ###" * 40 if i < 40 else ""), "en", "s", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i >= 40), 0) for i in range(400)], LABELS)
    stats = rules.counted(docs.withColumn("text", docs.text), "doc_id", "text")
    # Repeated windows fail the base rule, so the junk is given words of its own.
    found = rules.fit(stats.withColumn("n_repeat_words", stats.n_words * 0), labels, "doc_id", "doc_id", "quality", labelled=60)
    assert len(found.rules) == 1 and len(found.rules[0]) == 1
