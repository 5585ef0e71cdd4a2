"""Language and quality: held-out accuracy, calibration, the label model, odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import SCHEMA, clashing, table
from touchline.llm import langid, quality
from touchline.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op8_language"](spark, folder).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([docs[r.doc_id].lang == r.lang_pred for r in held]) > 0.97


def test_language_of_odd_rows(spark):
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 3, "en" if i % 2 else "de", "s", 1) for i in range(60)]
    rows += [(100, None, "en", "s", 1), (101, "12 !!", "en", "s", 1), (102, "", None, "s", 1), (None, "und der", None, "s", 1),
             (103, "the the " * 200000, None, "s", 1), (103, "the the", None, "s", 1)]
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    got = langid.identify(df, "doc_id", "text", "lang").collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [(by[i].lang_pred, by[i].score) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert by[None].lang_pred == "de" and by[103].lang_pred == "en"
    unlabelled = langid.identify(df.where("lang is null"), "doc_id", "text", "lang").collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
    assert langid.identify(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_counts_do_not_depend_on_parts(monkeypatch):
    codes = np.random.default_rng(0).integers(97, 110, 5000).astype(np.uint32)
    want = langid.gram_counts(codes)
    monkeypatch.setattr(langid, "PART", 700)
    got = langid.gram_counts(codes)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_temperature_recovers_the_scale():
    rnd = np.random.default_rng(1)
    logits = rnd.normal(size=(20000, 3)) * 2
    answers = np.array([rnd.choice(3, p=p) for p in langid.softmax(logits)])
    assert langid.temperature(logits * 4, answers) == pytest.approx(4, rel=0.1)


def test_penalty_makes_weights_sparse():
    rnd = np.random.default_rng(2)
    models = [langid.Regression(50, 2, l1=l1) for l1 in (0.0, 2.0)]
    for _ in range(300):
        k = int(rnd.integers(2))
        at = np.append(rnd.choice(np.arange(2, 50), 5, replace=False), k)
        for m in models:
            m.learn(at, np.ones(6), np.eye(2)[k])
    dense, sparse = (m.weights() for m in models)
    assert (sparse[2:50] == 0).mean() > 0.8 > (dense[2:50] == 0).mean()
    assert sparse[0, 0] > 0 > sparse[1, 0]


def test_label_model_finds_accuracies():
    rnd = np.random.default_rng(3)
    n, catch = 20000, [0.7, 0.5, 0.9, 0.3]
    bad = rnd.random(n) < 0.15
    digits = np.stack([np.where(bad & (rnd.random(n) < c), quality.BAD, np.where(rnd.random(n) < 0.2, quality.SILENT, quality.GOOD))
                       for c in catch], axis=1)
    pattern, counts = np.unique((digits * 3 ** np.arange(4)).sum(axis=1), return_counts=True)
    model = quality.label_model(pattern, counts, 4)
    good = dict(zip(pattern.tolist(), model.posterior(pattern).tolist(), strict=True))
    told = np.array([good[p] for p in (digits * 3 ** np.arange(4)).sum(axis=1).tolist()]) < 0.5
    assert (told == bad).mean() > 0.97
    assert (model.table[:, quality.GOOD, quality.BAD] < 0.01).all()
    assert np.argsort(model.accuracies()).tolist() == np.argsort(catch).tolist()


def test_quality_against_labels(spark):
    folder = "/root/testdata/sf0.01"
    kept = {r.doc_id: r.kept for r in QUERIES["op10_quality"](spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    assert np.mean([kept[r.doc_id] for r in labels if r.quality == 1]) > 0.97
    assert np.mean([kept[r.doc_id] for r in labels if r.quality == 0]) < 0.15


def test_quality_of_odd_rows(spark):
    rows = [(i, "a plain text of a few words that says little. " * 3 if i % 4 else "X!! Y!! $$$ ### ||| &&& " * 9, "en", "s", 1) for i in range(80)]
    rows += [(100, None, "en", "s", 1), (101, "", "en", "s", 1), (None, " \n", "en", "s", 1), (0, rows[0][1], "en", "s", 1)]
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    got = quality.quality(df, "doc_id", "text").collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].score for i in (100, 101, None)] == [0.0] * 3 and not by[100].kept
    assert by[1].kept and not by[0].kept
    assert quality.quality(df.limit(0), "doc_id", "text").count() == 0


def test_texts_leave_a_task_in_small_batches(spark, monkeypatch):
    docs = table(spark, ["some words of a text", None, "x"] * 40).coalesce(1).select("doc_id", "text")
    model, sizes = langid.LanguageModel([], np.ones(1 << langid.BITS), np.zeros(((1 << langid.BITS) + 1, 0), np.float32), 1.0), []
    frame = type(docs)
    whole = frame.mapInArrow

    def watched(self, run, schema, *more):
        batch = pa.RecordBatch.from_pylist([r.asDict() for r in docs.collect()], pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
        sizes.extend(b.num_rows for b in run(iter([batch])))
        return whole(self, run, schema, *more)

    monkeypatch.setattr(frame, "mapInArrow", watched)
    monkeypatch.setattr(langid, "SENT", 50)
    told = langid.predict(docs, model, "text", ["doc_id", "text"])
    assert sizes == [50, 50, 20]
    assert told.count() == 120
