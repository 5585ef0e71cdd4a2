"""Collocations against plain counting; windows, shards, odd rows."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from tests.llm.helpers import SCHEMA, clashing
from touchline.llm import collocations


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, least, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for size in (1, 2, 3):
                counts[lang].update(tuple(w[k:k + size]) for k in range(len(w) - size + 1))
    out = []
    for lang, f in counts.items():
        found, candidates = [], {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in candidates.items()):
                continue
            cuts = [(1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), lang, a, f[p[:k]], f[p[k:]], totals[lang], score))
        for rank, r in enumerate(sorted(found)[:top], 1):
            out.append((r[3], rank, r[2].decode(), *r[4:]))
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r) for r in collocations.collocations(df, "text", "lang", **options).collect())


def corpus(n=250):
    rnd = random.Random(2)
    words = [f"w{k}" for k in range(25)] + ["É", "Zed", "zed", "日本", "a b", "-", "x|y"]
    text = lambda: "".join(rnd.choice(words) + rnd.choice([" "] * 8 + ["  ", "\t", ". ", ",", "\n", "!?"]) for _ in range(rnd.randrange(60)))
    rows = [(rnd.choice(["en", "en", "de", None, "und"]), text()) for _ in range(n)]
    rows += [("en", "very common phrase here. " * 40), ("en", None), (None, ""), ("en", "one"), ("fr", " \t. ,")]
    return rows + rows[:20]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 1) for i, (g, t) in enumerate(rows)], SCHEMA)


def test_against_plain_counting(spark):
    rows = corpus()
    assert found(frame(spark, rows)) == plain(rows, 10)
    assert found(frame(spark, rows).repartition(7), least=3, top=9) == plain(rows, 3, 9)


def test_windows_of_one_task_join_up(spark, monkeypatch):
    rows = corpus(60)
    monkeypatch.setattr(collocations, "WINDOW", 7)
    monkeypatch.setattr(collocations, "GATHERED", 500)
    monkeypatch.setattr(collocations, "HANDED_ON", 3)
    got = Counter()
    batch = pa.RecordBatch.from_arrays([pa.array([g or "und" for g, _ in rows]), pa.array([t for _, t in rows])], ["_lang", "_text"])
    for out in collocations._stripe_rows(iter([batch])):
        for r in out.to_pylist():
            for entry in r["entries"].split("\n"):
                after, _, n = entry.partition("\t")
                got[r["lang"], r["first"], after] += int(n or 1)
    want = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            want[lang or "und", None, ""] += len(w)
            for size in (1, 2, 3):
                want.update((lang or "und", w[k], " ".join(w[k + 1:k + size])) for k in range(len(w) - size + 1))
    assert got == +want


def test_shards_are_the_same_for_any_window():
    one, two = pa.array(["b", "a", "long word"], pa.large_string()), pa.array(["x", "long word", "b"], pa.large_string())
    first, second = collocations._shards(one), collocations._shards(two)
    assert first[0] == second[2] and first[2] == second[1] and (first < collocations.SHARDS).all()


def test_odd_rows(spark):
    rows = [("en", "a b c " * 200000), ("en", "x" * 1_000_000), ("en", ". " * 300000), (None, None)]
    df = clashing(frame(spark, rows)).withColumnsRenamed({"source": "first", "n_chars": "_lang"})
    assert found(df) == plain(rows, 10)
    assert collocations.collocations(df.limit(0), "text", "lang").count() == 0


def test_products_beyond_64_bits(spark):
    sizes = [(3_000_000_000, 4_000_000_000, 5_000_000_000), (10, 10, 10)]
    df = spark.createDataFrame(sizes, "n bigint, l bigint, r bigint").selectExpr(f"{collocations._score('l', 'r')} as s", "n", "l", "r")
    assert [r.s for r in df.collect()] == [1000000 * n * n // (x * y) for n, x, y in sizes]
