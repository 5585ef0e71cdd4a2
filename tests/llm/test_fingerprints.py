"""Weighted samples: exact properties, and the collision rate against the true generalised Jaccard similarity."""

import hashlib
import random
from collections import Counter

from tests.llm.helpers import clashing, prose, table
from touchline.llm import sampling
from touchline.llm.queries import QUERIES


def test_equal_texts_and_odd_rows(spark):
    docs = clashing(table(spark, ["a b c", None, "", "a b c", " \n", (3, "a b c"), (None, "x y"), (None, None)]))
    rows = sampling.fingerprints(docs, "doc_id", "text").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.fingerprint)
    assert len(rows) == 7 and by[0] == by[3]
    assert by[1] == by[2] == by[4] == ["-" * 512]
    assert sampling.fingerprints(docs.limit(0), "doc_id", "text").count() == 0


def test_collisions_follow_similarity(spark):
    rnd = random.Random(3)
    texts, true = [], []
    for share in (0.0, 0.3, 0.6, 0.9):
        for _ in range(12):
            one = prose(rnd, 400, 150)
            two = [w if rnd.random() < share else f"v{rnd.randrange(150)}" for w in one]
            a, b = Counter(one), Counter(two)
            true.append(sum((a & b).values()) / sum((a | b).values()))
            texts += [" ".join(one), " ".join(two)]
    docs = table(spark, texts)
    drawn = sampling.samples(docs.select("doc_id", "text").repartition("doc_id"), ["doc_id"], "text")
    one = drawn.where("doc_id % 2 = 0").selectExpr("doc_id div 2 as pair", "samples as one")
    two = drawn.where("doc_id % 2 = 1").selectExpr("doc_id div 2 as pair", "samples as two")
    got = {r[0]: r[1] for r in one.join(two, "pair").select("pair", sampling.likeness("one", "two")).collect()}
    errors = [got[i] - t for i, t in enumerate(true)]
    assert abs(sum(errors) / len(errors)) < 0.03
    assert max(map(abs, errors)) < 0.25


def test_heavy_terms_keep_their_weight(spark):
    rnd = random.Random(8)
    texts, true = [], []
    for i in range(24):
        if i % 2:
            one, two = (["line"] * 300 + [f"{side}{i}w{k}" for k in range(60)] for side in "ab")
        else:
            one = [f"z{int(rnd.paretovariate(0.8))}" for _ in range(400)]
            two = [w if rnd.random() < 0.7 else f"z{int(rnd.paretovariate(0.8))}" for w in one]
        a, b = Counter(one), Counter(two)
        true.append(sum((a & b).values()) / sum((a | b).values()))
        texts += [" ".join(one), " ".join(two)]
    drawn = sampling.samples(table(spark, texts).select("doc_id", "text").repartition("doc_id"), ["doc_id"], "text")
    by = {r.doc_id: r.samples for r in drawn.collect()}
    errors = [sum(x == y for x, y in zip(by[2 * i], by[2 * i + 1], strict=True)) / 64 - t for i, t in enumerate(true)]
    print(sum(errors[::2]) / 12, sum(errors[1::2]) / 12)
    assert abs(sum(errors[::2]) / 12) < 0.06 and abs(sum(errors[1::2]) / 12) < 0.06


def test_query_edits_with_the_next_document(spark, tmp_path):
    texts = ["abc def ghi", "ÄÖ 😀 xyz", None, "one two three four five six", "", "same same"]
    table(spark, texts).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op1_weighted_samples"](spark, str(tmp_path)).collect()}
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        after = plain[i - 1]  # descending ids; after the least comes the greatest
        cut = len(t) // 3
        edited = t[:len(t) - cut] + after[:cut]
        assert rows[i].n_chars == len(t)
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    assert rows[2].fingerprint == rows[4].fingerprint and rows[2].near_edited == 1


def test_plan_has_no_python(spark, small):
    plan = QUERIES["op1_weighted_samples"](spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
