"""Shared passages: planted ones are found whole, clean documents left alone; parts against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import clashing, prose, same_beside, table
from touchline.llm import passages


@pytest.mark.parametrize("seed", range(20))
def test_minimisers_are_window_minima(seed):
    rnd = random.Random(seed)
    values = np.array([rnd.randrange(8) for _ in range(rnd.randint(0, 40))], np.uint64)
    window = rnd.randint(1, 6)
    want = {i for i in range(len(values)) for s in range(i - window + 1, i + 1)
            if values[i] == min(values[max(s, 0):s + window])}
    assert set(passages.minimisers(values, window).tolist()) == want


@pytest.mark.parametrize("seed", range(30))
def test_best_chain_equals_quadratic(seed):
    rnd = random.Random(seed)
    n, gap = rnd.randint(1, 40), rnd.choice([0.0, 0.02, 0.3])
    x, y = (np.array([rnd.randrange(30) for _ in range(n)]) for _ in range(2))
    order = sorted(range(n), key=lambda i: (x[i], y[i]))
    best = {}
    for i in order:
        best[i] = 1 + max([0, *(best[j] - gap * (x[i] - x[j] + y[i] - y[j]) for j in order if x[j] < x[i] and y[j] < y[i])])
    found = passages.chains(x, y, gap)
    assert sorted(i for c in found for i in c) == list(range(n))
    worth = [1 + sum(1 - gap * (x[b] - x[a] + y[b] - y[a]) for a, b in zip(c[:-1], c[1:], strict=True)) for c in found]
    assert max(worth) == pytest.approx(max(best.values()))
    assert all(x[a] < x[b] and y[a] < y[b] for c in found for a, b in zip(c[:-1], c[1:], strict=True))


def test_planted_passages(spark):
    rnd = random.Random(1)
    passage, fuzzy = prose(rnd, 60), prose(rnd, 90)
    worn = [w if i % 30 else f"edit{i}" for i, w in enumerate(fuzzy)]
    worn = worn[:40] + ["in", "serted"] + worn[40:]
    texts = [" ".join(prose(rnd, 80) + p + prose(rnd, 70)) for p in (passage, fuzzy, passage, worn, [], passage, [])]
    texts += [" ".join(passage[:35]), None, "", "short", " ".join(["same"] * 300)]
    docs = clashing(table(spark, [*texts, (None, texts[0]), (2, texts[2])]))
    rows = passages.passages(docs, "doc_id", "text").collect()
    assert {r.doc for r in rows} == {2, 3, 5}
    for r in rows:
        if r.doc != 3:
            assert texts[r.doc][r.start:r.stop] == " ".join(passage) == texts[0][r.home_start:r.home_stop]
            assert r.home == 0 and r.n_words == r.n_equal == 60
    covered = sum(len(texts[3][r.start:r.stop].split()) for r in rows if r.doc == 3)
    assert covered >= 85 and all(r.home == 1 for r in rows if r.doc == 3)


@pytest.mark.parametrize("seed", range(20))
def test_stretches_equal_recursion(seed):
    rnd = random.Random(seed)
    worth = np.array([rnd.choice([2, 1, -1, -3, -4]) for _ in range(rnd.randint(0, 60))])

    def plain(lo, hi):
        best = max(((worth[a:b].sum(), a - b, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
        return plain(lo, best[2]) + [best[2:]] + plain(best[3], hi) if best[0] > 0 else []

    # Sums may tie, but what the stretches are worth does not.
    value = lambda found: sorted(int(worth[a:b].sum()) for a, b in found)
    found = passages.stretches(worth)
    assert all(a[1] <= b[0] for a, b in zip(found[:-1], found[1:], strict=True))
    assert sum(value(found)) == sum(value(plain(0, len(worth)))) and max(value(found), default=0) == max(value(plain(0, len(worth))), default=0)


def test_two_passages_in_one_pair(spark):
    rnd = random.Random(4)
    texts, want = [], []
    for gap in (20, 80, 150):
        one, two = " ".join(prose(rnd, 60)), " ".join(prose(rnd, 55))
        for _ in range(2):
            texts.append(" ".join([*prose(rnd, 40), one, *prose(rnd, gap), two, *prose(rnd, 40)]))
        want += [(len(texts) - 1, one), (len(texts) - 1, two)]
    rows = passages.passages(table(spark, texts), "doc_id", "text").collect()
    assert sorted((r.doc, texts[r.doc][r.start:r.stop]) for r in rows) == sorted(want)
    assert all(r.home == r.doc - 1 for r in rows)


def _padded(rnd, *parts):
    return " ".join([*prose(rnd, 40), *(" ".join(p) for p in parts), *prose(rnd, 40)])


def test_passage_whose_parts_come_first_elsewhere(spark, monkeypatch):
    rnd = random.Random(5)
    whole, lines = prose(rnd, 50), [prose(rnd, 10) for _ in range(6)]
    texts = [_padded(rnd, prose(rnd, 9)), _padded(rnd, whole[:25]), _padded(rnd, whole[25:]), _padded(rnd, whole), _padded(rnd, whole)]
    texts += [_padded(rnd, line) for line in lines] + [_padded(rnd, *lines), _padded(rnd, *lines)]
    found = []
    for gathered, parts in ((300_000, 1), (60, 5)):
        monkeypatch.setattr(passages, "GATHERED", gathered)
        rows = passages.passages(table(spark, texts).repartition(parts), "doc_id", "text").collect()
        assert {(r.doc, r.home, texts[r.doc][r.start:r.stop]) for r in rows} == {
            (4, 3, " ".join(whole)), (12, 11, " ".join(w for line in lines for w in line))}
        found.append(sorted(rows))
    assert found[0] == found[1]


def test_second_copy_and_repeated_lines(spark):
    rnd = random.Random(6)
    passage, header, line = prose(rnd, 60), prose(rnd, 12), prose(rnd, 10)
    other = header + prose(rnd, 9) + header + prose(rnd, 9) + header + prose(rnd, 9) + header
    texts = [_padded(rnd, passage), _padded(rnd, passage, prose(rnd, 30), passage),
             _padded(rnd, other), _padded(rnd, *[header] * 4, prose(rnd, 30), other),
             _padded(rnd, line * 20), _padded(rnd, line * 20)]
    got = {i: [] for i in range(len(texts))}
    for r in passages.passages(table(spark, texts), "doc_id", "text").collect():
        assert r.home == r.doc - 1
        got[r.doc].append((r.start, r.stop))
    second = " ".join(passage)
    at = texts[1].index(second)
    last = texts[1].rindex(second)
    assert sorted(got[1]) == [(at, at + len(second)), (last, last + len(second))]
    for doc, want in ((3, " ".join(other)), (5, " ".join(line * 20))):
        at = texts[doc].rindex(want)
        assert any(a <= at and b >= at + len(want) for a, b in got[doc])


@pytest.mark.parametrize("seed", range(20))
def test_edited_stretches_are_met(seed):
    rnd = random.Random(seed)
    same = np.array([rnd.random() < rnd.choice([0.1, 0.7, 0.9]) for _ in range(rnd.randint(0, 60))], bool)
    total = np.concatenate([[0.0], np.cumsum(np.where(same, 0.2, -0.8))])
    found = passages._long_enough(np.where(same, 0.2, -0.8), same, 10)
    fits = {(a, b) for a in range(len(same)) for b in range(a + 10, len(same) + 1)
            if same[a] and same[b - 1] and total[b] - total[a] >= -1e-9}
    assert set(found) <= fits
    free = [f for f in fits if all(f[1] <= a or f[0] >= b for a, b in found)]
    assert not free and all(a[1] <= b[0] for a, b in zip(sorted(found)[:-1], sorted(found)[1:], strict=True))


def test_recall_of_edited_passages(spark):
    rnd = random.Random(7)
    texts, kinds = [], []
    for kind in [(n, alike, even) for n in (50, 60) for alike in (0.9, 0.85, 0.8) for even in (True, False)]:
        for _ in range(50):
            n, alike, even = kind
            edits = round(n * (1 - alike) + 1e-9)
            at = {int((i + 0.5) * n / edits) for i in range(edits)} if even else set(rnd.sample(range(1, n - 1), edits))
            one = prose(rnd, n)
            texts += [_padded(rnd, one), _padded(rnd, [f"edit{i}" if i in at else w for i, w in enumerate(one)])]
            kinds.append(kind)
    met = {r.doc // 2 for r in passages.passages(table(spark, texts), "doc_id", "text").collect() if r.home == r.doc - 1 and r.doc % 2}
    recall = {k: sum(i in met for i, x in enumerate(kinds) if x == k) / 50 for k in kinds}
    print(recall)
    assert all(v >= (0.98 if k[1] > 0.8 else 0.7) for k, v in recall.items())


def test_removal(spark):
    rnd = random.Random(2)
    passage = " ".join(prose(rnd, 55))
    texts = [f"é😀 {passage} end", f"start {passage} tail", passage, "clean text", None, ""]
    names = ["cuts", "_doc", "doc", "_new", "_text", "_rest", "_id", "start", "at", "home"]
    docs = table(spark, texts).selectExpr("*", *[f"concat('{c}', doc_id) as {c}" for c in names])
    out = passages.remove_passages(docs, "doc_id", "text", "n_chars")
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {0: (texts[0], len(texts[0])), 1: ("start  tail", 11), 3: ("clean text", 10), 4: (None, None), 5: ("", 0)}
    assert same_beside(docs, out, names)


def test_many_copies_of_one_passage(spark, monkeypatch):
    monkeypatch.setattr(passages, "GATHERED", 50)
    rnd = random.Random(3)
    passage = prose(rnd, 70)
    texts = [" ".join(prose(rnd, 20) + passage + prose(rnd, 20)) for _ in range(60)]
    rows = passages.passages(table(spark, texts), "doc_id", "text").collect()
    assert {r.doc for r in rows} == set(range(1, 60)) and all(r.home < r.doc and r.n_equal >= 70 for r in rows)


def test_empty(spark):
    assert passages.passages(table(spark, []), "doc_id", "text").count() == 0
    assert passages.remove_passages(table(spark, []), "doc_id", "text").count() == 0


def test_groups_of_matches_are_chained_together(monkeypatch):
    rnd = random.Random(4)
    rows, want, width = [], [], passages.WIDTH
    for doc in range(60):
        for home in range(3):
            lines = rnd.choice([1, 1, 2, 5])
            x = np.array([rnd.randint(0, 150) for _ in range(rnd.randint(1, 40))])
            y = x + np.array([rnd.choice(range(lines)) * 7 for _ in x])
            rows += sorted((doc, home, int(a), int(b)) for a, b in zip(x, y))
            _, tx, ty = passages._thinned(np.zeros(len(x), np.int64), x, y, width)
            for chain in passages.chains(tx, ty):
                cx, cy = tx[chain], ty[chain]
                if len(chain) > 1 and cx[-1] - cx[0] >= width:
                    turn = [0, *(np.flatnonzero(np.diff(cx - cy)) + 1).tolist(), -1]
                    want.append((doc, home, [int(v) for i in turn for v in (cx[i], cy[i])]))
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc", "home", "pos", "home_pos"])
    called, one_by_one = [], passages.chains
    monkeypatch.setattr(passages, "chains", lambda x, y, *a, **k: called.append((x - y).tolist()) or one_by_one(x, y, *a, **k))
    for chunk in (1, 50, 1 << 16):
        monkeypatch.setattr(passages, "CHUNK", chunk)
        parts = iter([batch.slice(at, 37) for at in range(0, batch.num_rows, 37)])
        found = [(r["doc"], r["home"], r["runs"]) for b in passages._chained(width)(parts) for r in b.to_pylist()]
        assert sorted(found) == sorted(want)
    # Matches on one diagonal without wide gaps take no tree.
    plain = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*[(1, 0, i, i) for i in range(0, 90, 3)])], batch.schema.names)
    called.clear()
    assert [r["runs"] for b in passages._chained(width)(iter([plain])) for r in b.to_pylist()] == [[0, 0, 87, 87]]
    assert not called


def test_contexts_do_not_depend_on_chunks(monkeypatch):
    rnd = random.Random(5)
    rows = []
    for doc in range(40):
        pos = 0
        for _ in range(rnd.randint(1, 60)):
            pos += rnd.choice([1, 2, 3, 3, 30])
            rows.append((doc, pos << 2, rnd.getrandbits(60), rnd.randint(0, 2), pos + rnd.choice([0, 0, 5]) << 2))
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc", "mark", "hash", "home", "home_mark"])
    monkeypatch.setattr(passages, "_gathered", lambda pieces: pieces)
    seen = []
    for chunk in (1, 200, 1 << 16):
        monkeypatch.setattr(passages, "CHUNK", chunk)
        parts = iter([batch.slice(at, 50) for at in range(0, batch.num_rows, 50)])
        pieces = list(passages._contexts([25, 50], passages.WIDTH, passages.WINDOW)(parts))
        seen.append((len(pieces), sorted(x for p in pieces for x in zip(*(v.tolist() for v in p)))))
    assert seen[0][1] == seen[1][1] == seen[2][1] and seen[0][1]
    # All documents of a chunk are handled at once: at most one piece a length.
    assert seen[2][0] <= 2


@pytest.mark.parametrize("split", [1, 7, 1000])
def test_packed_seeds_meet_their_first_document(split):
    rnd = random.Random(split)
    rows = {(rnd.choice([5, -7, 2**62, -2**63, *range(40)]), rnd.randrange(30), rnd.randrange(50) << 2) for _ in range(400)}
    tasks = [[r for r in rows if r[1] % 3 == n] for n in range(3)]
    packed, linked = [], []
    for cells in [13]:
        for task in tasks:
            batch = passages._reduced(*(np.array(v, k) for v, k in zip(zip(*[(r[0] % 2**64, *r[1:]) for r in task]), (np.uint64, np.int64, np.int64))))
            linked += [tuple(r.values()) for r in batch.to_pylist() if r["home"] is not None]
            packed += passages._packed(lambda batches: batches, cells)(iter([batch]))
    table_ = pa.Table.from_batches(packed).sort_by("cell").combine_chunks().to_batches()[0]
    parts = [table_.slice(at, split) for at in range(0, table_.num_rows, split)]
    found = [tuple(r.values()) for b in passages._meet(iter(parts)) for r in b.to_pylist()]
    assert sorted(r[:5] for r in found if r[5]) == sorted(linked)
    # The first document of a seed, of those that are the first of their task, is the home of the others.
    homes, want = {}, set()
    for task in tasks:
        for hash, doc, mark in sorted(task):
            first = min(d for h, d, _ in task if h == hash)
            if doc == first:
                shared = passages.SHARED if any(h == hash and d != doc for h, d, _ in task) else 0
                homes.setdefault(hash, []).append((doc, mark | shared))
    for hash, firsts in homes.items():
        home, home_mark = min(firsts)
        alone = len(firsts) == 1 and not home_mark & passages.SHARED
        want |= set() if alone else {(hash, d, m, home, home_mark) for d, m in firsts if (d, m) != (home, home_mark) or m & passages.SHARED}
        want |= {(hash, home, home_mark, home, home_mark)} if any(d != home for d, _ in firsts) else set()
    assert {r[:5] for r in found if not r[5]} == want and want


def test_rows_of_a_document_come_in_any_order(monkeypatch):
    rnd = random.Random(8)
    rows = sorted({(doc, pos, rnd.getrandbits(40), rnd.randint(0, 2), pos + rnd.choice([0, 0, 5])) for doc in range(20) for pos in range(0, 150, 3)})
    names = ["doc", "mark", "hash", "home", "home_mark"]
    batch = lambda rows, order: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in order], [names[i] for i in order])
    mixed = sorted(rows, key=lambda r: (r[0], rnd.random()))
    monkeypatch.setattr(passages, "_gathered", lambda pieces: pieces)
    marks = lambda rows: [(d, p << 2, h, o, q << 2) for d, p, h, o, q in rows]
    contexts = [sorted(x for p in passages._contexts([25, 50], 4, 3)(iter([batch(marks(r), range(5))])) for x in zip(*(v.tolist() for v in p)))
                for r in (rows, mixed)]
    chained = [sorted((r["doc"], r["home"], r["runs"]) for b in passages._chained(4)(iter([batch(r, [0, 3, 1, 4])])) for r in b.to_pylist())
               for r in (sorted(rows, key=lambda r: (r[0], r[3], r[1], r[4])), mixed)]
    assert contexts[0] == contexts[1] and contexts[0] and chained[0] == chained[1] and chained[0]


def test_texts_are_not_stored_again(spark, monkeypatch):
    rnd, stored, cut = random.Random(9), [], passages.cut_lineage
    monkeypatch.setattr(passages, "cut_lineage", lambda df: stored.extend(df.dtypes) or cut(df))
    one = prose(rnd, 60)
    assert passages.passages(table(spark, [_padded(rnd, one), _padded(rnd, one)]), "doc_id", "text").count() == 1
    assert stored and not [c for c in stored if c[1] == "string"]
