"""Best-fit packing: against one-by-one best fit, the tokenizer itself, and gapless places."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import clashing, same_beside, table
from touchline.llm import packing
from touchline.llm.arrow_text import blocks
from touchline.llm.queries import QUERIES, vocabulary

PATH = vocabulary("word_bpe_49k.json")


def one_by_one(lengths, size):
    open_ = []
    for n in sorted(lengths, reverse=True):
        fits = [c for c in open_ if c >= n]
        if fits:
            open_.remove(min(fits))
            open_.append(min(fits) - n)
        else:
            open_.append(size - n)
    return sorted(open_)


@pytest.mark.parametrize("seed", range(30))
def test_runs_equal_best_fit_one_by_one(seed):
    rnd = random.Random(seed)
    size = rnd.choice([7, 16, 50, 100])
    lengths = [rnd.randint(1, size) for _ in range(rnd.randint(0, 300))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs = packing.best_fit_runs(counts, size)
    used = {}
    for n, total in counts.items():
        mine = sorted(r for r in runs if r[0] == n)
        for rank in range(total):
            _, first_rank, first, per, offset = [r for r in mine if r[1] <= rank][-1]
            d = rank - first_rank
            used.setdefault(first + d // per, []).append((offset + d % per * n, n))
    for places in used.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= size
    assert sorted(size - sum(n for _, n in p) for p in used.values()) == one_by_one(lengths, size)


def test_ids_are_the_librarys():
    rnd = random.Random(1)
    texts = ["", " ", "  a  b", "It's they'RE don't. x's!", "<|startoftext|> a<|endoftext|>b <|endOFtext|>", "日本語の テキスト", "é́ x ́",
             "Σας ΣΑΣ İ ſ K Å", "\x1ca\x1db\x85c\xa0d e​f", "ÀÉ, Übung. ß! ẞ;", "a" * 3000]
    texts += ["".join(rnd.choice("abeinrt .,'s\ńÉ\xa0 \x1cétion!?") for _ in range(rnd.randint(0, 300))) for _ in range(200)]
    texts += ["".join(chr(rnd.choice([rnd.randint(1, 126), rnd.randint(160, 1500), rnd.randint(0x2000, 0x9000),
                                      rnd.randint(0x1F300, 0x1F6FF)])) for _ in range(rnd.randint(0, 100))) for _ in range(200)]
    library, own = packing._tokenizer(PATH), packing._known(PATH)
    for t in texts:
        got = np.frombuffer(b"".join(own(packing._words(t))), np.uint32).tolist()
        assert got == library.encode(t, add_special_tokens=False).ids, t


def test_packed_documents(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(4000))
    texts = [None, "", "one two", long, "one two", *[f"text {i} " * (i % 50) for i in range(300)], (2, "one two"), (None, "x")]
    docs = clashing(table(spark, texts))
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op2_pack_best_fit"](spark, str(tmp_path)).collect()
    library = packing._tokenizer(PATH)
    expected = []
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], np.uint32)
        for k in range(0, len(ids), 4096):
            expected.append((r.doc_id or -1, k // 4096, k, len(ids[k:k + 4096]), zlib.crc32(ids[k:k + 4096].tobytes())))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= 4096
    assert len(sequences) == len(one_by_one([r.length for r in rows], 4096))


def test_columns_of_callers_stay(spark):
    names = ["_share", "_n", "_in", "_place", "_skip", "_piece", "_length", "rank"]
    df = spark.range(50).selectExpr("id as doc_id", "id % 7 + 1 as length", *[f"concat('{c}', id) as {c}" for c in names])
    out = packing.pack(df, "length", 16)
    assert out.columns == [*df.columns, "sequence_id", "offset"] and out.count() == 50 and same_beside(df, out, names)
    assert packing.pack(df.select("length", "_n"), "length", 16, ("_n",)).groupBy("sequence_id").sum("length").where("`sum(length)` > 16").count() == 0


def test_empty_table_and_wrong_lengths(spark):
    assert packing.pack_documents(table(spark, []), "doc_id", "text", PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(5000,)], "length bigint"), "length", 4096)


def test_a_word_is_looked_up_once_a_block(monkeypatch):
    own = packing.WordIds(PATH)
    asked, core = [], own.core
    monkeypatch.setattr(own, "core", lambda words: asked.extend(words) or core(words))
    texts = ["Word word, WORD.  x\x85y ", "", " \t\n", "word x\x85y; été. ÉTÉ", "日本"] * 50
    column = pa.array(texts)
    [(_, data, offsets)] = list(blocks(column))
    ids, ends = packing._text_ids(data, offsets, own, 1)
    assert sorted(asked) == sorted({"word", " x\x85y", " x\x85y;", "été", " 日本"})
    library = packing._tokenizer(PATH)
    for text, got in zip(texts, np.split(ids, ends[:-1])):
        assert got.tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]
