"""The pipeline as a whole: stages' columns, their effects, and odd rows."""

import random

import pyarrow as pa

import corpus_pipeline
from tests.llm.helpers import prose, table
from touchline.llm.queries import vocabulary


def test_stages(spark, tmp_path):
    rnd = random.Random(4)
    shared = " ".join(prose(rnd, 60))
    base = prose(rnd, 120)
    texts = [" ".join(base), " ".join(base[:-1] + ["other"]), f"{' '.join(prose(rnd, 40))} {shared}", f"{' '.join(prose(rnd, 40))} {shared}",
             "words before token = 'q1w2e3r4t5y6' and after", "12 34 !!", None, "", *[" ".join(prose(rnd, 50)) for _ in range(20)]]
    docs = table(spark, [*texts, (None, "text without an id")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert now.columns == docs.columns and now.dtypes == docs.dtypes
            now.write.parquet(f"{tmp_path}/{n}")
            now = spark.read.parquet(f"{tmp_path}/{n}")
        rows = {r.doc_id: r for r in now.collect()}
        if name == "language":
            assert set(rows) == {i for i in range(28) if i not in (5, 6, 7)} | {None}
        if name == "near_duplicates":
            assert 1 not in rows and 0 in rows and None in rows and len(rows) == 25
        if name == "passages":
            assert shared in rows[2].text and shared not in rows[3].text and rows[3].n_chars == len(rows[3].text)
        if name == "secrets":
            assert rows[4].text == "words before [SECRET]' and after"
    assert {r.doc_id for r in now.collect()} == set(rows)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda r: (r.doc_id or -1, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, whole.collect())) == sorted(map(key, now.collect()))


def test_empty_table(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_vocabularies_are_there():
    assert vocabulary("word_bpe_49k.json").endswith("word_bpe_49k.json")


def test_stages_send_texts_in_small_batches(spark, monkeypatch):
    name, limit = corpus_pipeline.BATCH_BYTES
    before = spark.conf.get(name)
    monkeypatch.setattr(corpus_pipeline.packing, "pack_documents", lambda *a: a[0])
    docs = spark.range(0, 40, 1, 1).selectExpr("id as doc_id", "repeat('word ', 100000) as text")

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    try:
        told = corpus_pipeline.packed(spark, docs, "").mapInArrow(rows, "n bigint").collect()
    finally:
        spark.conf.set(name, before)
    assert sum(r.n for r in told) == 40
    assert max(r.n for r in told) * 500_000 < 2 * int(limit)
