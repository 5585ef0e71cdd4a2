"""Repair of conversations: cells against full parsing with all splits and against all edits, slices, odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from touchline.llm import conversations as c
from touchline.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?")


def all_splits(codes):
    """Cells of every span from every split, as in parsing by a general grammar."""
    cell = {(i, i + 1): c.row_cell(x) for i, x in enumerate(codes)}
    for size in range(2, len(codes) + 1):
        for i in range(len(codes) - size + 1):
            ways = [c.combined(cell[i, m], cell[m, i + size]) for m in range(i + 1, i + size)]
            assert all(w == ways[0] for w in ways)
            cell[i, i + size] = ways[0]
    return cell[0, len(codes)]


def every_edit(codes):
    """The least (cost, audit) by trying all edits of few rows."""
    best = None
    options = []
    for x in codes:
        initial, fault = divmod(ord(x) - 97, 4)
        extra = 5 if fault == 3 else 0
        row = [(2, "D", "")]
        if fault not in (1, 2):
            row += [(extra, "K", c.INITIALS[initial]), (extra + 1, "R", "u"), (extra + 1, "R", "a")]
        options.append(row)
    inserts = [(0, "", ""), (5, "I", "u"), (5, "I", "a"), (10, "II", "ua"), (10, "II", "au")]
    for rows in itertools.product(*options):
        for gaps in itertools.product(inserts, repeat=len(codes) + 1):
            cost = sum(r[0] for r in rows) + sum(g[0] for g in gaps)
            if best is not None and cost > best[0]:
                continue
            merged = [x for pair in itertools.zip_longest(gaps, rows) for x in pair if x]
            if PATTERN.fullmatch("".join(m[2] for m in merged)):
                found = (cost, "".join(m[1] for m in merged))
                best = found if best is None else min(best, found)
    return best


def parsed(codes, size=99):
    cells = [c.span_cell(codes[k:k + size]) for k in range(0, len(codes), size)]
    ranked = []
    for cell in cells:
        rank = {a: k for k, a in enumerate(sorted({x[1] for x in cell if x}))}
        ranked.append(([x and x[0] for x in cell], [x and rank[x[1]] for x in cell]))
    cost, path, tail = c.best_path(ranked)
    return cost, "".join(cell[4 * p + q][1] for cell, p, q in zip(cells, path, path[1:], strict=False)) + "I" * tail


LETTERS = [c.code(i, f) for i in range(4) for f in range(4)]


def test_all_edits_of_few_rows():
    for codes in LETTERS + ["".join(p) for p in itertools.product(LETTERS, repeat=2)]:
        assert parsed(codes) == every_edit(codes), codes
    rnd = random.Random(1)
    for _ in range(12):
        codes = "".join(rnd.choice(LETTERS) for _ in range(3))
        assert parsed(codes) == every_edit(codes), codes


def test_any_split_gives_the_same_cell_and_slices_combine():
    rnd = random.Random(2)
    for n in (1, 2, 3, 5, 9, 17):
        for _ in range(6):
            codes = "".join(rnd.choice(LETTERS) for _ in range(n))
            assert c.span_cell(codes) == all_splits(codes)
            assert parsed(codes) == parsed(codes, 1) == parsed(codes, 4)


def plain(rows):
    """The contract's results, with the row-by-row least (cost, audit) in place of spans."""
    out = {}
    for conv in {r[0] for r in rows}:
        damaged = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            space = lambda v: " " if v is None else str(v)
            kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
            role, text = space(role), space(text)
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            damaged += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        damaged.sort()
        faults, seen, codes = [], set(), ""
        for _, _, role, text in damaged:
            if not re.search(r"[^\x20\x09-\x0D]", text):
                fault = 1
            elif (role, text) in seen:
                fault = 2
            else:
                fault = 0 if text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")[-1] in ".!?" else 3
            seen.add((role, text))
            faults.append(fault)
            codes += c.code("sua".find(role[:1]) if role[:1] and role[:1] in "sua" else 3, fault)
        turns = {t for some, t, _, _ in damaged if some}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = parsed(codes, 1) if codes else (0, "")
        lines = []
        for _, row, edit, initial in c.rows_of(codes, audit, 0):
            name = {"s": "system", "u": "user", "a": "assistant"}[initial]
            lines.append(f"{damaged[row][2]}:{damaged[row][3]}" if edit == "K" else f"{name}:{'' if row is None else damaged[row][3]}")
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(damaged))
        out[conv] = (gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def results(rows):
    return {r.conv_id: tuple(r)[1:] for r in rows}


def test_query_against_plain(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_repair_conversations"](spark, folder).collect()
    assert len(got) == len({r[0] for r in rows}) and results(got) == plain(rows)


def odd():
    rnd = random.Random(3)
    texts = ["yes.", "no", "", " \n", None, "why?", "é!", "so. \r\n", "a.\nb", "x" * 300000 + "."]
    rows = [(rnd.randrange(40), rnd.choice([None, *range(9)]), rnd.choice(["user", "assistant", "system", "user", "assistant", None, "tool", ""]),
             rnd.choice(texts)) for _ in range(500)]
    rows += [(None, 1, "user", "ok?"), (None, 2, "assistant", "ok."), (None, None, None, None)]
    rows += [(700, k, ("user", "assistant")[k % 2], f"row {k}.") for k in range(400)]
    rows += [(701, 5, "user", "again.")] * 60 + [(702, 0, "user", "x")]
    return rows


@pytest.mark.parametrize("size", [3, 1 << 14])
def test_odd_rows(spark, monkeypatch, size):
    monkeypatch.setattr(c, "SLICE", size)
    rows = odd()
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("conv", "at", "new", "codes", "_start", "copies", "audit", "k"):
        df = df.selectExpr("*", f"'x' as {name}")
    got = c.repaired_digests(df).collect()
    assert len(got) == len({r[0] for r in rows}) and results(got) == plain(rows)


def test_empty(spark):
    assert c.repaired_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_after_repair(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "assistant", "Hello"), (2, 0, "assistant", "Well."),
            (3, 0, "user", "Why?"), (4, 0, "user", "One."), (4, 1, "user", "Two.")]
    summary, repaired = c.repair(spark.createDataFrame(rows, SCHEMA), "conv_id")
    by = {r.conv: (r.cost, r.audit) for r in summary.collect()}
    got = {}
    for r in repaired.orderBy("conv", "at", "k").collect():
        got.setdefault(r.conv, []).append((r.edit, r.role, r.text))
    assert by[4] == (1, "KR") and got[4] == [("K", "user", "One."), ("R", "assistant", "Two.")]
    assert by[2] == (2, "D") and 2 not in got
    for conv, edits in got.items():
        assert PATTERN.fullmatch("".join(role[0] for _, role, _ in edits)), conv
