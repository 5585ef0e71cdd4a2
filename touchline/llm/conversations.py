"""Repair of conversation structure: weighted CYK over spans of rows.

A repaired conversation reads ``(s?(ua)+)?`` by the initials of its roles. In Chomsky normal form that language has one
symbol per pair of places in the pattern, with the rules [p,q] -> [p,r] [r,q] and [p,q] -> an edited row. A span's cell
holds, for each pair, the least (cost, audit) of edits that lead from p to q. Rows' cells are closed under insertions
before the row; an insertion after the last row closes the whole. Spans are combined bottom-up by length: 1, 2, 4, ...
rows. Because every split of a span yields the same cell (the rules are associative, and audits of equal rows never
begin one another), one split of each is enough, and cells of slices of one conversation combine like any others.

So a conversation is no unit of work: rows are ordered once over the sort's balanced partitions and cut into slices of
a fixed number of rows. A slice gives 16 costs and 16 audits, and only costs and the audits' order meet across slices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.scan import rank_all
from touchline.session import cut_lineage

#: Rows of a slice at most.
SLICE = 1 << 14
#: Cost of an edit, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, STAYS_TRUNCATED = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
#: Places in the pattern: at its beginning, after s, after u, after a; where a row of an initial leads to.
PLACES = 4
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = {0, 3}
INITIALS, FAULTS = "sua?", ("none", "blank", "duplicate", "truncated")
LEGAL = {"su", "ua", "au"}
_CELL = "array<struct<cost:bigint,audit:string>>"


def code(initial: int, fault: int) -> str:
    """A row as one letter: its initial (other ones count as one) and its first fault."""
    return chr(97 + initial * len(FAULTS) + fault)


def _insertions() -> list[list[tuple[int, int]]]:
    """From each place: places that insertions alone lead to, and the least number of them."""
    out = []
    for p in range(PLACES):
        least, edge = {p: 0}, [p]
        while edge:
            step = [q for at in edge for (at2, c), q in MOVES.items() if at2 == at and c in ROLES and q not in least]
            least |= {q: least[edge[0]] + 1 for q in step}
            edge = step
        out.append(sorted(least.items()))
    return out


INSERTIONS = _insertions()


@lru_cache
def row_cell(letter: str) -> list[tuple[int, str] | None]:
    """The cell of one row, closed under insertions before it; entry 4 * p + q."""
    initial, fault = divmod(ord(letter) - 97, len(FAULTS))
    edited: list[list[tuple[int, int, str]]] = [[(p, DELETE, "D")] for p in range(PLACES)]
    if FAULTS[fault] not in ("blank", "duplicate"):
        extra = STAYS_TRUNCATED if FAULTS[fault] == "truncated" else 0
        for (p, c), q in MOVES.items():
            if c == INITIALS[initial]:
                edited[p].append((q, KEEP + extra, "K"))
            if c in ROLES:
                edited[p].append((q, REROLE + extra, "R"))
    cell: list[tuple[int, str] | None] = [None] * (PLACES * PLACES)
    for p in range(PLACES):
        for at, n in INSERTIONS[p]:
            for q, cost, edit in edited[at]:
                found = (cost + INSERT * n, "I" * n + edit)
                known = cell[PLACES * p + q]
                cell[PLACES * p + q] = found if known is None else min(known, found)
    return cell


def combined(left, right):
    """The cell of two adjoining spans."""
    cell = []
    for p in range(PLACES):
        for q in range(PLACES):
            best = None
            for r in range(PLACES):
                a, b = left[PLACES * p + r], right[PLACES * r + q]
                if a is None or b is None:
                    continue
                cost = a[0] + b[0]
                if best is None or cost < best[0] or (cost == best[0] and a[1] + b[1] < best[1]):
                    best = (cost, a[1] + b[1])
            cell.append(best)
    return cell


def span_cell(codes: str) -> list[tuple[int, str] | None]:
    """The cell of a slice, spans combined bottom-up by length."""
    spans = [row_cell(c) for c in codes]
    while len(spans) > 1:
        joined = [combined(spans[k], spans[k + 1]) for k in range(0, len(spans) - 1, 2)]
        spans = joined + spans[len(spans) - len(spans) % 2:]
    return spans[0]


_short_cell = lru_cache(1 << 16)(span_cell)


def illegal(codes: str) -> int:
    """Adjoining rows whose initials do not follow one another."""
    initials = [INITIALS[(ord(c) - 97) // len(FAULTS)] for c in codes]
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def best_path(slices: list[tuple[list[int | None], list[int | None]]]) -> tuple[int, list[int], int]:
    """(cost, places at the slices' borders, insertions at the end) of the least (cost, audit).

    A slice is its cell's costs and the order of its cell's audits. Audits of a slice end with a row, so none begins
    another, and comparing their orders slice by slice compares the whole audits.
    """
    at, back = {0: (0, 0)}, []
    for costs, orders in slices:
        found: dict[int, tuple] = {}
        for p, (cost, rank) in at.items():
            for q in range(PLACES):
                if costs[PLACES * p + q] is not None:
                    way = (cost + costs[PLACES * p + q], rank, orders[PLACES * p + q], p)
                    found[q] = min(found.get(q, way), way)
        # The audits so far are told apart by their order alone.
        ranks = {audit: k for k, audit in enumerate(sorted({way[1:3] for way in found.values()}))}
        at = {q: (way[0], ranks[way[1:3]]) for q, way in found.items()}
        back.append({q: way[3] for q, way in found.items()})
    cost, _, tail, place = min(
        (cost + INSERT * n, rank, n, p) for p, (cost, rank) in at.items() for q, n in INSERTIONS[p] if q in ENDS)
    path = [place]
    for step in reversed(back):
        path.append(step[path[-1]])
    return cost, path[::-1], tail


def rows_of(codes: str, audit: str, place: int) -> list[tuple[int, int | None, str, str]]:
    """(position in the audit, row of the slice or None, edit, initial) of every row that the edits give."""
    out, row = [], 0
    for k, edit in enumerate(audit):
        if edit == "D":
            row += 1
            continue
        initial = INITIALS[(ord(codes[row]) - 97) // len(FAULTS)] if edit == "K" else ("a" if place == 2 else "u")
        out.append((k, None if edit == "I" else row, edit, initial))
        place = MOVES[place, initial]
        row += edit != "I"
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells, orders, wrong = [], [], []
        for codes in batch.column(1).to_pylist():
            cell = (_short_cell if len(codes) <= 12 else span_cell)(codes)
            rank = {a: k for k, a in enumerate(sorted({c[1] for c in cell if c}))}
            cells.append([None if c is None else {"cost": c[0], "audit": c[1]} for c in cell])
            orders.append([None if c is None else rank[c[1]] for c in cell])
            wrong.append(illegal(codes))
        struct = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(cells, struct), pa.array(orders, pa.list_(pa.int32())),
             pa.array(wrong, pa.int64())], ["_start", "codes", "cell", "orders", "illegal"])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per slice: where its part of the best path begins and ends, and insertions after it."""
    for batch in batches:
        start, begin, end, tail, wrong, total = [], [], [], [], [], []
        for slices in batch.column(0).to_pylist():
            cost, path, n = best_path([(s["costs"], s["orders"]) for s in slices])
            borders = "".join(s["ends"] for s in slices)
            for k, s in enumerate(slices):
                start.append(s["_start"])
                begin.append(path[k])
                end.append(path[k + 1])
                tail.append(n if k + 1 == len(slices) else 0)
                wrong.append(illegal(borders[2 * k - 1:2 * k + 1]) if k else 0)
                total.append(0 if k else cost)
        yield pa.RecordBatch.from_arrays(
            [pa.array(start, pa.int64()), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(tail, pa.int32()),
             pa.array(wrong, pa.int64()), pa.array(total, pa.int64())],
            ["_start", "begin", "end", "tail", "between", "cost"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    entry = pa.list_(pa.struct([("k", pa.int32()), ("row", pa.int32()), ("edit", pa.string()), ("initial", pa.string())]))
    for batch in batches:
        found = [[dict(zip(("k", "row", "edit", "initial"), e, strict=True)) for e in rows_of(codes, audit, place)]
                 for codes, audit, place in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, entry)], ["_start", "entries"])


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text with planted faults, chosen by crc32 of ``conv:turn`` modulo 20: 0 drops a row, 1 empties its
    text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it the user's. Null roles and texts are one space."""
    or_space = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", or_space(conv), or_space(turn))) % 20
    return rows.select(
        rows[conv].alias("conv"), rows[turn].alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(or_space(role)).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(or_space(text), ".!?", "")).otherwise(or_space(text)).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    ).where("copies > 0").select("conv", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")


def repair(rows: DataFrame, conv: str = "conv", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(summary, repaired): per conversation its faults and cheapest edits, and its rows after them.

    summary: conv, gaps, blank, duplicate, truncated, illegal, cost, audit. repaired: conv, at, k (both give the order),
    edit (K, R or I), role, text.

    Rows of a conversation go by turn (nulls first), then role, then text; repeated rows each count. Null roles and texts
    are one space, a null conversation is one like others. A role that begins with neither s, u nor a can't be kept.
    Other columns are ignored; an empty table gives two empty ones. Texts of any length are only sorted and compared.
    """
    named = rows.select(
        rows[conv].alias("conv"), rows[turn].alias("turn"), F.coalesce(rows[role], F.lit(" ")).alias("role"),
        F.coalesce(rows[text], F.lit(" ")).alias("text"))
    ranked = rank_all(named, ["conv", F.asc_nulls_first("turn"), "role", "text"], "at", "_size").drop("_size")
    # What stands first of equal rows; found by a digest, so that texts do not travel. Places are unique, so the join
    # back has no hot key however often a row repeats.
    first = ranked.groupBy("conv", "role", F.sha2("text", 256)).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), 1).when(F.col("new").isNull(), 2)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), 3).otherwise(0)
    )
    initial = F.instr(F.lit(INITIALS[:3]), F.when(F.col("role") != "", F.substring("role", 1, 1)))
    initial = F.when(F.coalesce(initial, F.lit(0)) == 0, 3).otherwise(initial - 1)
    told = ranked.join(first, "at", "left").select(
        "conv", "at", "turn", F.char(97 + initial * len(FAULTS) + fault).alias("code"), fault.alias("fault"))
    slices = cut_lineage(
        told.groupBy("conv", F.floor(F.col("at") / SLICE).alias("_slice"))
        .agg(F.min("at").alias("_start"), F.array_sort(F.collect_list(F.struct("at", "code"))).alias("_rows"),
             *[F.count_if(F.col("fault") == k).alias(FAULTS[k]) for k in (1, 2, 3)])
        .withColumn("codes", F.array_join(F.transform("_rows", lambda r: r["code"]), "")).drop("_slice", "_rows"))
    cells = cut_lineage(slices.select("_start", "codes").mapInArrow(
        _cells, f"_start bigint, codes string, cell {_CELL}, orders array<int>, illegal bigint"))
    # Per slice 16 costs and 16 small numbers meet in a conversation, a few bytes for thousands of rows.
    paths = (
        slices.drop("codes").join(cells, "_start").groupBy("conv")
        .agg(F.array_sort(F.collect_list(F.struct(
            "_start", F.transform("cell", lambda c: c["cost"]).alias("costs"), "orders",
            F.concat(F.substring("codes", 1, 1), F.substring("codes", -1, 1)).alias("ends")))).alias("slices"))
        .select("slices").mapInArrow(
            _paths, "_start bigint, begin int, end int, tail int, between bigint, cost bigint")
    )
    edits = cut_lineage(
        cells.join(paths, "_start").select(
            "_start", "codes", F.concat(
                F.element_at("cell", F.col("begin") * PLACES + F.col("end") + 1)["audit"], F.expr("repeat('I', tail)")).alias("audit"),
            "begin", "cost", (F.col("illegal") + F.col("between")).alias("illegal")))
    turns = told.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"))
    summary = (
        slices.drop("codes").join(edits.select("_start", "audit", "cost", "illegal"), "_start").groupBy("conv")
        .agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
             F.array_sort(F.collect_list(F.struct("_start", "audit"))).alias("_audits"))
        .withColumn("audit", F.array_join(F.transform("_audits", lambda a: a["audit"]), "")).drop("_audits")
        .withColumnRenamed("conv", "_conv")
    )
    summary = summary.join(turns, F.col("_conv").eqNullSafe(F.col("conv"))).select(
        "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    entries = (
        edits.select("_start", "codes", "audit", "begin")
        .mapInArrow(_entries, "_start bigint, entries array<struct<k:int,row:int,edit:string,initial:string>>")
        .selectExpr("_start", "inline(entries)")
    )
    new_role = F.when(F.col("initial") == "u", ROLES["u"]).otherwise(ROLES["a"])
    kept = entries.where("row is not null").withColumn("at", F.col("_start") + F.col("row")).join(ranked, "at").select(
        "conv", F.col("_start").alias("at"), "k", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(new_role).alias("role"), "text")
    added = entries.where("row is null").join(slices.select("_start", "conv"), "_start").select(
        "conv", F.col("_start").alias("at"), "k", "edit", new_role.alias("role"), F.lit("").alias("text"))
    return summary, kept.unionByName(added)


def digests(repaired: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of ``role:text`` of a conversation's rows, newline-joined.

    A digest runs over a conversation's rows one after the other; they pass by sorted, one batch is held at a time.
    """
    key = repaired.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, at, digest = None, None, None
        for batch in batches:
            names, sums = [], []
            for c, head, line in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if digest is not None and c == conv:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        names.append(conv)
                        sums.append(digest.hexdigest())
                    conv, digest = c, hashlib.sha256()
                digest.update(head.encode() + b":" + line.encode())
            yield out(names, sums)
        if digest is not None:
            yield out([conv], [digest.hexdigest()])

    def out(names, sums) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(sums, pa.string())], ["conv", "repaired_sha256"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(repaired.schema["conv"].dataType)
    return repaired.repartition("conv").sortWithinPartitions("conv", "at", "k").select("conv", "role", "text").mapInArrow(
        run, f"conv {key}, repaired_sha256 string")


def repaired_digests(conversations: DataFrame) -> DataFrame:
    """Every conversation of a table (conv_id, turn, role, text) after ``damage``: its faults, cheapest edits and digest."""
    summary, repaired = repair(damage(conversations))
    every = conversations.select(conversations["conv_id"]).distinct()
    found = summary.join(digests(repaired).withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
