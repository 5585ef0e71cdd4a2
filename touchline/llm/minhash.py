"""Near-duplicate documents by MinHash: universal hash minima, bands, signature checks, exact checks, components.

Texts with equal shingle sets form a class and go on as one row. Classes that agree in a band meet its hub, the least
class there. Pairs whose signatures agree enough are held against their full shingle sets. Links grow into components by
large-star and small-star. What shares a band but not a component is then compared too, in blocks, so a link between two
classes that share a band is never lost. With 30 bands of 5 minima a pair at similarity 0.85 shares none with a chance
of 2e-8, and the signature check (6 standard deviations below the threshold) passes all but 1e-9 of such pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.arrow_text import blocks, column, mix, shingle_sets
from touchline.llm.components import components
from touchline.session import cut_lineage

WIDTH, BANDS, ROWS = 5, 30, 5
#: Classes of one block when a band's classes are compared with each other.
BLOCK = 256
#: Up to so many ids (8 bytes each) are broadcast to find their texts; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def _universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of ``n`` hash functions of 64-bit numbers."""
    draw = np.random.default_rng(7).integers(0, 2**64, (2, n), np.uint64, endpoint=False)
    return draw[0] | np.uint64(1), draw[1]


def signatures(docs: DataFrame, id: str, text: str, width: int = WIDTH, hashes: int = BANDS * ROWS) -> DataFrame:
    """Per row: id, n_shingles (distinct), h1 and h2 (hashes of the set), sig (``hashes`` little-endian 32-bit minima; null
    for a text without words). Nothing is shuffled; a task holds one block of texts and its shingles."""
    key = docs.schema[id].dataType.simpleString()
    names = [id, "n_shingles", "h1", "h2", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multiply, add = _universal(hashes)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for _, data, offsets in blocks(column(batch, "_text")):
                sets = shingle_sets(data, offsets, width)
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                full = np.flatnonzero(sizes)
                minima = np.zeros((len(full), hashes), np.uint32)
                h1 = h2 = np.zeros(len(full), np.uint64)
                if len(full):
                    flat = np.concatenate(sets)
                    first = np.cumsum(sizes[full]) - sizes[full]
                    h1 = np.add.reduceat(mix(flat), first)
                    h2 = np.bitwise_xor.reduceat(mix(flat * np.uint64(3)), first)
                    for k in range(hashes):
                        minima[:, k] = np.minimum.reduceat(flat * multiply[k] + add[k], first) >> np.uint64(32)
                rows: list[list] = [[0] * len(sets), [0] * len(sets), [None] * len(sets)]
                for i, at in enumerate(full.tolist()):
                    rows[0][at], rows[1][at] = int(h1.view(np.int64)[i]), int(h2.view(np.int64)[i])
                    rows[2][at] = minima[i].tobytes()
                for have, more in zip(out, [sizes.tolist(), *rows], strict=True):
                    have += more
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(v, pa.int64()) for v in out[:3]], pa.array(out[3], pa.binary())], names)

    return docs.select(docs[id].alias("_id"), docs[text].alias("_text")).mapInArrow(
        run, f"`{id}` {key}, n_shingles bigint, h1 bigint, h2 bigint, sig binary")


def _agreeing(least: int):
    """Keeps the pairs (a, b) whose signatures share ``least`` minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (_minima(batch.column(i)) for i in (2, 3))
                keep = pa.array((one == two).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)

    return run


def _minima(sigs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), np.uint32).reshape(len(sigs), -1)


def _alike(width: int, part: int, whole: int):
    """Keeps the pairs (a, b) whose full sets satisfy whole * |intersection| >= part * |union|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, np.ndarray] = ("", np.zeros(0, np.uint64))
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                if last[0] != (text := one.as_py()):  # pairs come sorted by a
                    last = (text, _set(text, width))
                a, b = last[1], _set(two.as_py(), width)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(whole * both >= part * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(
                pa.array(keep, pa.bool_()))

    return run


def _set(text: str, width: int) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return shingle_sets(data, np.array([0, len(data)]), width)[0]


def _texts(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The rows of ``docs`` whose _id is among the at most ``n`` ``ids``; stored."""
    ids = ids.distinct()
    return cut_lineage(docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "_id", "left_semi"))


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, threshold: tuple[int, int],
               least: int) -> DataFrame:
    """The pairs (a, b) that pass the signature check and then the check of full sets; stored."""
    one = classes.select(F.col("rep").alias("a"), F.col("sig").alias("_s1"))
    two = classes.select(F.col("rep").alias("b"), F.col("sig").alias("_s2"))
    likely = cut_lineage(pairs.join(one, "a").join(two, "b").select("a", "b", "_s1", "_s2")
                         .mapInArrow(_agreeing(least), pairs.select("a", "b").schema))
    texts = _texts(docs, likely.select(F.col("a").alias("_id")).union(likely.select("b")), 2 * likely.count())
    one = texts.select(F.col("_id").alias("a"), F.col("_text").alias("_t1"))
    two = texts.select(F.col("_id").alias("b"), F.col("_text").alias("_t2"))
    return cut_lineage(likely.join(two, "b").join(one, "a").select("a", "b", "_t1", "_t2")
                       .mapInArrow(_alike(width, *threshold), likely.schema))


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(rep, words): the full shingle set of each text as sorted 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [s.tobytes() for _, data, offsets in blocks(column(batch, "_text"))
                   for s in shingle_sets(data, offsets, width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["rep", "words"])

    return texts.select("_id", "_text").mapInArrow(run, "rep bigint, words binary").dropDuplicates(["rep"])


def _rest(members: DataFrame, comp: DataFrame, classes: DataFrame, docs: DataFrame, width: int,
          threshold: tuple[int, int], least: int, rows: int) -> DataFrame:
    """Links (a, b) between classes that share a band but no component yet; stored.

    In each band, O are the classes outside the band's main component. Pairs needed are O x O and O x main. Both kinds are
    dealt to blocks, and a class goes to each pair of blocks that needs it. A pair is checked in the first band it shares, by
    signature and then by sets; only confirmed links come out, and only those that join components.
    """
    named = (
        members.join(comp.select(F.col("node").alias("rep"), F.col("component").alias("c")), "rep", "left")
        .withColumn("c", F.coalesce("c", "rep"))
    )
    # Any component of the band may be the main one: the least is easily found, and mostly the hub's.
    mixed = (
        named.groupBy("band").agg(F.min("c").alias("main"), F.max("c").alias("_hi")).where("main < _hi").drop("_hi")
    )
    deal = lambda df: df.withColumn("_band", F.bitwise_not("band"))  # noqa: E731  dealt anew: a hot band can be split
    found = cut_lineage(deal(named).join(deal(mixed).drop("band"), "_band").drop("_band")
                        .withColumn("_out", F.col("c") != F.col("main")))
    keys = ["band", "lo", "hi"]
    by_key = lambda df: df.repartition(*keys).sortWithinPartitions(*keys)
    # Signatures first: only classes that some stranger of their band resembles go on with their sets.
    near = cut_lineage(by_key(_dealt(found, classes, None)).mapInArrow(
        _resembling(least, rows), "band bigint, rep bigint").distinct())
    found = cut_lineage(found.join(near, ["band", "rep"], "left_semi"))
    ids = cut_lineage(found.select(F.col("rep").alias("_id")).distinct())
    full = cut_lineage(_sets(_texts(docs, ids, ids.count()), width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, whole = threshold
        for group in _groups(batches, 3):
            band = group.column(3)[0].as_py()
            own, rep, c = (group.column(i).to_numpy() for i in (4, 5, 6))
            sig = _minima(group.column(7))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column(8)]
            lengths = np.fromiter(map(len, sets), np.int64, len(sets))
            apart = group.column(1)[0].as_py() != group.column(2)[0].as_py()
            joined, links = dict(zip(c.tolist(), c.tolist(), strict=True)), []

            def root(x: int, joined=joined) -> int:
                while joined[x] != x:
                    x = joined[x]
                return x

            for i in range(len(rep) - 1):
                at = _partners(i, own if apart else None, c, sig, least, rows, band)
                # Sets of very different sizes can't be alike enough.
                at = at[whole * np.minimum(lengths[at], lengths[i]) >= part * np.maximum(lengths[at], lengths[i])]
                if not len(at):
                    continue
                flat = np.concatenate([sets[j] for j in at])
                place = np.minimum(np.searchsorted(sets[i], flat), lengths[i] - 1)
                both = np.add.reduceat((sets[i][place] == flat).astype(np.int64), np.cumsum(lengths[at]) - lengths[at])
                for j in at[whole * both >= part * (lengths[at] + lengths[i] - both)]:
                    x, y = root(int(c[i])), root(int(c[j]))
                    if x != y:
                        joined[max(x, y)] = min(x, y)
                        links.append((int(rep[i]), int(rep[j])))
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return cut_lineage(by_key(_dealt(found, classes, full)).mapInArrow(run, "a bigint, b bigint"))


def _dealt(found: DataFrame, classes: DataFrame, full: DataFrame | None) -> DataFrame:
    """The classes of ``found``, each once for each pair of blocks of its band that needs it, with signatures (and sets)."""
    deal = lambda df: df.withColumn("_band", F.bitwise_not("band"))
    sizes = found.groupBy("band").agg(
        F.ceil(F.sum(F.col("_out").cast("long")) / BLOCK).alias("_o"),
        F.ceil(F.sum((~F.col("_out")).cast("long")) / BLOCK).alias("_m"))
    own = F.when(F.col("_out"), F.pmod(F.xxhash64("rep"), F.greatest("_o", F.lit(1)))).otherwise(
        F.col("_o") + F.pmod(F.xxhash64("rep"), F.greatest("_m", F.lit(1))))
    last = F.when(F.col("_out"), F.col("_o") + F.col("_m")).otherwise(F.col("_o")) - 1
    spread = (
        deal(found).join(deal(sizes).drop("band"), "_band").where("_o > 0").withColumn("own", own.cast("long"))
        .withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
        .select("band", F.least("own", "_p").alias("lo"), F.greatest("own", "_p").alias("hi"), "n", "own", "rep", "c")
        .join(classes.select("rep", "sig"), "rep")
    )
    columns = ["band", "lo", "hi", "n", "own", "rep", "c", "sig"]
    return spread.select(*columns) if full is None else spread.join(full, "rep").select(*columns, "words")


def _partners(i: int, own: np.ndarray | None, c: np.ndarray, sig: np.ndarray, least: int, rows: int, band: int) -> np.ndarray:
    """Later classes of a block that resemble class ``i``, lie in other components (and, given ``own``, in the other block)
    and share no band with it before this one."""
    other = c[i + 1:] != c[i]
    if own is not None:
        other &= own[i + 1:] != own[i]
    at = i + 1 + np.flatnonzero(other)
    equal = sig[at] == sig[i]
    keep = equal.sum(axis=1) >= least
    at, equal = at[keep], equal[keep]
    return at[equal.reshape(len(at), -1, rows).all(axis=2).argmax(axis=1) == band] if len(at) else at


def _resembling(least: int, rows: int):
    """(band, rep) of the classes of sorted blocks that have a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            band = group.column(3)[0].as_py()
            own, rep, c = (group.column(i).to_numpy() for i in (4, 5, 6))
            sig = _minima(group.column(7))
            apart = group.column(1)[0].as_py() != group.column(2)[0].as_py()
            met = np.zeros(len(rep), bool)
            for i in range(len(rep) - 1):
                at = _partners(i, own if apart else None, c, sig, least, rows, band)
                met[at] = True
                met[i] |= len(at) > 0
            if met.any():
                yield pa.RecordBatch.from_arrays(
                    [group.column(0).filter(pa.array(met)), pa.array(rep[met], pa.int64())], ["band", "rep"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows that agree in the first ``keys`` columns, of sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy() for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        if held and any(held[-1].column(i)[-1].as_py() != cols[i][0] for i in range(keys)):
            yield pa.concat_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo and held:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.concat_batches(held)


def near_duplicates(docs: DataFrame, id: str, text: str, threshold: tuple[int, int] = (85, 100), width: int = WIDTH,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: id, n_shingles, component_id (least id reachable over links, itself included), kept (id = component_id).

    A row's set are the distinct runs of ``width`` words of its whole text, or all its words as one run if there are
    fewer. Rows are linked if threshold[1] * |intersection| >= threshold[0] * |union|. Null texts and texts without words
    have empty sets, which link with nothing. Ids are integers; rows that share an id count as one document; a row with a
    null id represents nothing: its component_id is that of its equals, else null, and it is kept only in the latter case.
    Other columns are ignored. An empty table gives an empty one.
    """
    docs = docs.select(docs[id].cast("long").alias("_id"), docs[text].alias("_text"))
    total = bands * rows
    share = threshold[0] / threshold[1]
    least = max(1, math.floor(total * share - 6 * math.sqrt(total * share * (1 - share))))
    sigs = cut_lineage(signatures(docs, "_id", "_text", width, total))
    classes = cut_lineage(
        sigs.where("n_shingles > 0").groupBy("h1", "h2", "n_shingles", "sig").agg(F.min("_id").alias("rep"))
        .where("rep is not null"))
    keys = [F.xxhash64(F.lit(b), F.substring("sig", 4 * rows * b + 1, 4 * rows)) for b in range(bands)]
    banded = classes.select("rep", F.posexplode(F.array(*keys)).alias("n", "band"))
    hubs = banded.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("_hi")).where("hub < _hi")
    members = cut_lineage(
        banded.withColumn("_k", F.bitwise_not("band"))
        .join(hubs.select(F.bitwise_not("band").alias("_k"), "hub"), "_k").select("band", "n", "rep", "hub"))
    star = members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    links = _confirmed(star, classes, docs, width, threshold, least)
    comp = components(links)
    rest = _rest(members, comp, classes, docs, width, threshold, least, rows)
    if not rest.isEmpty():
        comp = components(links.union(rest))
    labels = (
        classes.join(comp, F.col("rep") == F.col("node"), "left")
        .select("h1", "h2", "n_shingles", F.coalesce("component", "rep").alias("component"))
        # Two classes may share their least id; then both have the same component.
    )
    return (
        sigs.select("_id", "n_shingles", "h1", "h2").join(labels, ["h1", "h2", "n_shingles"], "left")
        .select(
            F.col("_id").alias(id), "n_shingles", F.coalesce("component", "_id").alias("component_id"),
            F.coalesce(F.col("_id") == F.coalesce("component", "_id"), F.col("component").isNull()).alias("kept"))
    )
