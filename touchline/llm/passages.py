"""Fuzzy passages that documents share: seeds, collinear chains, alignment.

Every text gives minimiser seeds: of each ``WINDOW`` runs of ``WIDTH`` words in a row, the one with the least hash. A seed's
home is its first document, so a document meets homes, not all that share a seed. Seeds are reduced to their first document
within every task before they are dealt by hash, and what they hid is linked to that document and on to its home: a common
passage gives as many rows as documents have it, never pairs among them. Where adjoining seeds have different homes, all
shared seeds within a passage's length are dealt as one, to the first document that has them together. Matches of a document and a home are chained in order, with gap
costs, by a Fenwick tree; chains are aligned word by word along their diagonals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.llm.arrow_text import blocks, column, mix, shingles, spans, word_hashes, words
from touchline.llm.minhash import BROADCAST_IDS
from touchline.session import cut_lineage

WIDTH, WINDOW = 4, 3
#: A passage has so many words, this share of them alike.
MIN_WORDS, ALIKE = 50, 0.8
#: Seeds that a task gathers before it reduces them.
GATHERED = 150_000
#: Rows that a task sends at once.
SENT = 1 << 15
#: Cells of hashes, unless there are more partitions; rows that have a home already and travel together.
CELLS, TOLD = 1 << 12, 1 << 8
#: Sorted rows that a task handles at once, if no group has more.
CHUNK = 1 << 16
#: A match is worth 1; a word of either text that a chain skips costs this.
GAP = 1 / 60
#: Words beyond a chain's ends that alignment looks at: seeds near a passage's end may have other homes.
REACH = 200

#: A mark is a word's place in the upper bits, then whether other documents of the task have the seed, and whether it is numbered.
SHARED, NUMBERED = 2, 1


def minimisers(kmers: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the least value of some ``window`` neighbours in a row (all of them, if there are fewer)."""
    if not len(kmers):
        return np.zeros(0, np.int64)
    top = np.uint64(2**64 - 1)
    pad = np.full(window - 1, top)
    least = _sliding(np.concatenate([pad, kmers, pad]), window, np.minimum)
    highest = _sliding(least, window, np.maximum)
    return np.flatnonzero((highest == kmers) & (kmers != top))


def _sliding(x: np.ndarray, window: int, pick) -> np.ndarray:
    """``pick`` of every ``window`` values in a row, by doubling."""
    have = 1
    while have < window:
        step = min(have, window - have)
        x = pick(x[:-step], x[step:])
        have += step
    return x


def _seeds(data: np.ndarray, offsets: np.ndarray, width: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text of the block, mark) of the seeds of a block; texts of fewer than ``width`` words have none."""
    hashes, _, _, at = words(data, offsets)
    if len(hashes) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    kmers = shingles(hashes, width)
    owner = np.searchsorted(at, np.arange(len(kmers)), side="right") - 1
    # Runs across two texts are no seeds.
    kmers[np.arange(len(kmers)) + width > at[owner + 1]] = np.uint64(2**64 - 1)
    chosen = minimisers(kmers, window)
    seeds, owner = kmers[chosen], owner[chosen]
    mark = chosen - at[owner] << 2
    # Repeats inside a text meet the home's first one, and once more, told apart by their number, its repeats one by one.
    order = np.lexsort((chosen, seeds, owner))
    new = np.r_[True, (seeds[order][1:] != seeds[order][:-1]) | (owner[order][1:] != owner[order][:-1])]
    turn = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    again, turn = order[turn > 0], turn[turn > 0]
    numbered = mix(seeds[again] + turn.astype(np.uint64))
    return (np.concatenate([seeds, numbered]), np.concatenate([owner, owner[again]]),
            np.concatenate([mark, mark[again] | NUMBERED]))


def _chunks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """About ``CHUNK`` rows of sorted batches, whole groups of rows that agree in the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    size, least = 0, CHUNK
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < least:
            continue
        rows = pa.concat_batches(held)
        values = [rows.column(i).to_numpy() for i in range(keys)]
        at = max((int(np.flatnonzero(np.r_[False, v[1:] != v[:-1]])[-1:].sum()) for v in values))
        if at:
            yield rows.slice(0, at)
        held, size = [rows.slice(at)], size - at
        # A group longer than that is gathered by doubling.
        least = max(CHUNK, 2 * size)
    if held:
        yield pa.concat_batches(held)


_FOUND = ["hash", "doc", "mark", "home", "home_mark"]
_KINDS = "hash bigint, doc bigint, mark bigint, home bigint, home_mark bigint"
_PACKED = "cell bigint, told boolean, rows binary"


def _reduced(hash: np.ndarray, doc: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
    """What a seed's first document has of it (home null), and the other documents' with its first place there as home."""
    order = np.lexsort((mark, doc, hash))
    hash, doc, mark = hash[order], doc[order], mark[order]
    start = np.flatnonzero(np.r_[True, hash[1:] != hash[:-1]])
    group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(hash)]))
    own = doc[start][group] == doc
    mark = np.where(own & np.logical_or.reduceat(~own, start)[group], mark | SHARED, mark)
    return pa.RecordBatch.from_arrays(
        [pa.array(hash.view(np.int64)), pa.array(doc), pa.array(mark), pa.array(doc[start][group], mask=own),
         pa.array(mark[start][group], mask=own)], _FOUND)


def _gathered(pieces: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """``_reduced`` of every ``GATHERED`` rows or so."""
    held: list[tuple] = []
    size = 0
    for piece in pieces:
        held.append(piece)
        size += len(piece[0])
        if size >= GATHERED:
            yield _reduced(*map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if size:
        yield _reduced(*map(np.concatenate, zip(*held, strict=True)))


def _packed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], cells: int):
    """What ``run`` gives, a row of bytes per cell: a cell holds the first documents' rows (three numbers each) of a range of
    hashes. The other documents' rows (five numbers) meet nothing there and go anywhere."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            for told, width in ((False, 3), (True, 5)):
                rows = batch.filter(batch.column(3).is_valid() if told else batch.column(3).is_null())
                if not rows.num_rows:
                    continue
                values = np.stack([rows.column(i).to_numpy() for i in range(width)], axis=1)
                hash = values[:, 0].view(np.uint64)
                if told:
                    first = np.arange(0, len(values), TOLD)
                    cell = (mix(hash[first] + values[first, 3].view(np.uint64)) % np.uint64(cells)).astype(np.int64)
                else:
                    cell = ((hash >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
                    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                    cell = cell[first]
                ends = np.r_[first, len(values)] * 8 * width
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), pa.array(np.full(len(first), told)), pa.Array.from_buffers(
                        pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])],
                    ["cell", "told", "rows"])

    return pack


def _unpacked(packed: pa.Array, width: int) -> np.ndarray:
    """The rows of ``width`` numbers in a column of bytes."""
    _, offsets, data = packed.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(packed.type) else np.int32)[packed.offset:][:len(packed) + 1]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].view(np.int64).reshape(-1, width)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed rows sorted by cell: all of a seed with their first one as home; first ones too if others share the seed.

    Rows that have a home already go on as they are.
    """
    held: list[np.ndarray] = []
    for batch in batches:
        told = batch.filter(batch.column(1))
        if told.num_rows:
            yield from _sent(_unpacked(told.column(2), 5).T, True)
        batch = batch.filter(pc.invert(batch.column(1)))
        if not batch.num_rows:
            continue
        cell = batch.column(0).to_numpy()
        cut = int(np.searchsorted(cell, cell[-1]))
        # The last cell may go on in the next batch, and the one before in this.
        if cut:
            yield from _sent(_met(np.concatenate([*held, _unpacked(batch.column(2).slice(0, cut), 3)])), False)
            held = []
        elif held and last != cell[0]:
            yield from _sent(_met(np.concatenate(held)), False)
            held = []
        held.append(_unpacked(batch.column(2).slice(cut), 3))
        last = cell[-1]
    if held:
        yield from _sent(_met(np.concatenate(held)), False)


def _met(rows: np.ndarray) -> list[np.ndarray]:
    """Columns of ``_FOUND`` for all rows (hash, doc, mark) of some seeds."""
    hash, doc, mark = np.ascontiguousarray(rows.T)
    order = np.argsort(hash)
    same = np.diff(hash[order]) == 0
    # A seed that one row has is of no use, unless other documents of its task have it.
    order = order[np.r_[False, same] | np.r_[same, False] | (mark[order] & SHARED > 0)]
    order = order[np.lexsort((mark[order], doc[order], hash[order]))]
    hash, doc, mark = hash[order], doc[order], mark[order]
    new = np.r_[True, hash[1:] != hash[:-1]][:len(hash)]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    home, home_mark, former = doc[first], mark[first], np.r_[0, doc[:-1]][:len(doc)]
    # The first one is told once more when the next document of the seed comes.
    met = ~new & (doc != home) & (former == home)
    keep = ~new | (mark & SHARED > 0)
    return [np.concatenate([v[keep], w[met]]) for v, w in
            ((hash, hash), (doc, home), (mark, home_mark), (home, home), (home_mark, home_mark))]


def _sent(columns: Iterable[np.ndarray], linked: bool) -> Iterator[pa.RecordBatch]:
    """Small batches: the JVM holds a whole one outside its heap."""
    columns = [pa.array(np.ascontiguousarray(c)) for c in columns]
    rows = pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(columns[0]), linked))], [*_FOUND, "linked"])
    for at in range(0, rows.num_rows, SENT):
        yield rows.slice(at, SENT)


def _homes(found: DataFrame) -> DataFrame:
    """(hash, doc, mark, home, home_mark) of seeds that several documents share; a home is the first document of all.

    ``found`` is packed: Spark deals and sorts cells, rows are sorted in them. What a task linked to its own first document goes
    on to that one's home: by keys of a seed and a task's document, so a common seed's rows stay spread.
    """
    dealt = cut_lineage(found.repartition("cell").sortWithinPartitions("cell").mapInArrow(_meet, _KINDS + ", linked boolean"))
    met = dealt.where("not linked").drop("linked")
    onward = met.where("doc <> home").selectExpr("hash", "doc as home", "mark as home_mark", "home as _home", "home_mark as _mark")
    linked = cut_lineage(dealt.where("linked").join(onward, ["hash", "home", "home_mark"], "left").select(
        "hash", "doc", "mark", F.coalesce("_home", "home").alias("home"), F.coalesce("_mark", "home_mark").alias("home_mark")))
    return met.union(linked)


SPAN = 20
_TURN = 0x9E3779B97F4A7C15


def _contexts(lengths: list[int], width: int, window: int):
    """Per document (rows sorted by it): hashes of its shared seeds within each of ``lengths`` words, where these have no common home in line.

    A repeated run has seeds at most ``window`` words apart, all of them shared. The last seed's distance stands in the lower
    ``SPAN`` bits of the place.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        power = back = np.ones(1, np.uint64)
        for chunk in _chunks(batches, 1):
            doc, mark = (chunk.column(i).to_numpy() for i in range(2))
            order = np.lexsort((mark, doc))
            doc, pos, hash, home, home_pos = (chunk.column(i).to_numpy()[order] for i in range(5))
            pos = pos >> 2
            one = np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])]
            doc, pos, hash, home, line = doc[one], pos[one], hash[one].view(np.uint64), home[one], (home_pos[one] >> 2) - pos[one]
            if (top := int(pos.max())) >= len(power):
                n = 2 * top + 2
                power, back = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, x, np.uint64)])
                               for x in (_TURN, pow(_TURN, -1, 2**64)))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hash) * power[pos], dtype=np.uint64)])
            turns = np.concatenate([[0], np.cumsum((np.diff(home) != 0) | (np.diff(line) != 0))])
            breaks = np.concatenate([[0], np.cumsum(np.diff(pos) > window)])
            # Places on one line, a document so far behind the former that no length reaches it.
            new = np.r_[False, doc[1:] != doc[:-1]]
            ahead = np.cumsum(np.where(new, np.r_[0, pos[:-1]] + max(lengths, default=0) + 1, 0))
            place, first = pos + ahead, np.arange(len(pos))
            for length in lengths:
                end = np.searchsorted(place, place + length - width, side="right") - 1
                full = pos[end] + width - pos + window > length
                a = np.flatnonzero((turns[end] > turns[first]) & (breaks[end] == breaks[first]) & full)
                if len(a):
                    b = end[a]
                    sums = mix((total[b + 1] - total[a]) * back[pos[a]] + np.uint64(length))
                    yield sums, doc[a], (pos[a] << SPAN | pos[b] - pos[a]) << 2

    return lambda batches: _gathered(pieces(batches))


def matches(docs: DataFrame, id: str, text: str, width: int = WIDTH, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, pos, home, home_pos): a seed at word ``pos`` of ``doc`` that an earlier document (smaller id), its home, has at
    ``home_pos``. Seeds are dealt once; only shared ones are stored.

    Where adjoining seeds have different homes, or one home has them elsewhere, the shared seeds within part of ``min_words``
    and within all of it are dealt as one to the first document that has them in line.
    """
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for row, data, offsets in blocks(column(batch, "_text")):
                    hash, owner, mark = _seeds(data, offsets, width, window)
                    yield hash, ids[row + owner], mark

        return _gathered(pieces())

    # Some cells a partition, but not so many that a task has few rows of each.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = max(parts, min(16 * parts, CELLS))
    found = (docs.where(docs[id].isNotNull()).select(docs[id].cast("long").alias("_id"), docs[text].alias("_text"))
             .mapInArrow(_packed(gather, cells), _PACKED))
    homes = _homes(found)
    lengths = sorted({n for n in (-(-min_words * k // 20) for k in (10, 15, 18, 20)) if n > width})
    longer = (
        homes.where(f"mark & {NUMBERED} = 0").select("doc", "mark", "hash", "home", "home_mark").repartition("doc")
        .sortWithinPartitions("doc").mapInArrow(_packed(_contexts(lengths, width, window), cells), _PACKED))
    single = homes.where("doc <> home").selectExpr(
        "doc", "shiftright(mark, 2) as pos", "home", "shiftright(home_mark, 2) as home_pos")
    # Both ends of a context are seeds.
    ends = _homes(longer).where("doc <> home").selectExpr(
        "doc", f"shiftright(mark, {SPAN + 2}) as pos", "home", f"shiftright(home_mark, {SPAN + 2}) as home_pos",
        f"explode(array(0L, shiftright(mark, 2) & {(1 << SPAN) - 1})) as _more")
    return single.union(ends.selectExpr("doc", "pos + _more as pos", "home", "home_pos + _more as home_pos"))


class Fenwick:
    """Greatest (value, item) among positions up to one."""

    def __init__(self, n: int):
        self.value, self.item = [-np.inf] * (n + 1), [-1] * (n + 1)

    def put(self, at: int, value: float, item: int) -> None:
        at += 1
        values, items, n = self.value, self.item, len(self.value)
        while at < n:
            if value > values[at]:
                values[at], items[at] = value, item
            at += at & -at

    def best(self, upto: int) -> tuple[float, int]:
        """Of positions 0..``upto`` - 1."""
        values, value, at = self.value, -np.inf, 0
        while upto:
            if values[upto] > value:
                value, at = values[upto], upto
            upto -= upto & -upto
        return value, self.item[at]


def chains(x: np.ndarray, y: np.ndarray, gap: float = GAP, least: int = 1) -> list[np.ndarray]:
    """Disjoint chains of the matches (x, y), as indices; each rises in x and y and is worth its matches less its gaps.
    Those of fewer than ``least`` matches are left out.

    f(i) = 1 + max(0, max f(j) - gap * (x_i - x_j + y_i - y_j)) over j with smaller x and y; as the cost is linear, the best
    j is the one with the greatest f(j) + gap * (x_j + y_j) below y_i, which a Fenwick tree over y finds.
    """
    # Matches of equal x go from high to low y, so none follows another.
    order = np.lexsort((-y, x)).tolist()
    ys, rank = np.unique(y, return_inverse=True)
    cost, rank = (gap * (x + y)).tolist(), rank.tolist()
    tree, score, former = Fenwick(len(ys)), [1.0] * len(order), [-1] * len(order)
    for i in order:
        value, j = tree.best(rank[i])
        gain = value - cost[i]
        if j >= 0 and gain > 0:
            score[i], former[i] = 1 + gain, j
        tree.put(rank[i], score[i] + cost[i], i)
    used, out = [False] * len(order), []
    for i in np.argsort(-np.array(score), kind="stable").tolist():
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = former[i]
        if len(chain) >= least:
            out.append(np.array(chain[::-1]))
    return out


def _thinned(group: np.ndarray, x: np.ndarray, y: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per group the ends of each run of overlapping matches on one diagonal, and one for every ``width`` words in between;
    by group, diagonal and x."""
    order = np.lexsort((x, x - y, group))
    group, x, y = group[order], x[order], y[order]
    apart = (np.diff(group) != 0) | (np.diff(x - y) != 0)
    once = np.r_[True, apart | (np.diff(x) != 0)]
    group, x, y, apart = group[once], x[once], y[once], np.r_[True, apart][once][1:]
    new = np.r_[True, apart | (np.diff(x) > width)]
    since = x - x[new][np.cumsum(new) - 1]
    keep = new | np.r_[new[1:], True] | np.r_[True, since[1:] // width > since[:-1] // width]
    return group[keep], x[keep], y[keep]


def _chained(width: int):
    """Per (doc, home) of rows sorted by doc: the chains that have two seeds without common words, as runs on one diagonal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, 1):
            doc, home = (chunk.column(i).to_numpy() for i in range(2))
            order = np.lexsort((home, doc))
            doc, home, x, y = (chunk.column(i).to_numpy()[order] for i in range(4))
            new = np.r_[True, (doc[1:] != doc[:-1]) | (home[1:] != home[:-1])]
            doc, home = doc[new], home[new]
            group, x, y = _thinned(np.cumsum(new) - 1, x, y, width)
            start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            end, line = np.r_[start[1:], len(group)], x - y
            wide = np.maximum.reduceat(x, start) - np.minimum.reduceat(x, start) >= width
            # Matches on one diagonal whose gaps all cost less than a match is worth are one chain.
            step = np.r_[np.diff(x), 0]
            step[end - 1] = 0
            plain = (line[start] == line[end - 1]) & (2 * GAP * np.maximum.reduceat(step, start) < 0.99)
            at = np.flatnonzero(wide & plain)
            a, b = start[at], end[at] - 1
            docs, homes = doc[group[a]].tolist(), home[group[a]].tolist()
            runs = np.stack([x[a], y[a], x[b], y[b]], axis=1).tolist()
            for g in np.flatnonzero(wide & ~plain).tolist():
                px, py = x[start[g]:end[g]], y[start[g]:end[g]]
                for chain in chains(px, py, least=2):
                    cx, cy = px[chain], py[chain]
                    if cx[-1] - cx[0] < width:
                        continue
                    turn = np.flatnonzero(np.diff(cx - cy)) + 1
                    docs.append(int(doc[group[start[g]]]))
                    homes.append(int(home[group[start[g]]]))
                    runs.append([int(v) for i in (0, *turn.tolist(), -1) for v in (cx[i], cy[i])])
            if docs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(homes, pa.int64()), pa.array(runs, pa.list_(pa.int64()))], _CHAIN)

    return run


_CHAIN = ["doc", "home", "runs"]


def align(one: np.ndarray, two: np.ndarray, runs: list[int], alike: float, min_words: int,
          reach: int = REACH) -> list[tuple[int, int, int, int, int]]:
    """The stretches of ``min_words`` or more along a chain: (first, end) word in ``one``, (first, end) in ``two``, number of equal words.

    ``runs``: where the chain enters each diagonal (x, y), then its last match. Words are compared along the diagonals; from
    one to the next it changes where most words are equal. Equal words count 1 - ``alike``, others -``alike``, a
    change of diagonal as many words as it shifts; the stretch with the greatest sum is taken, then those left and right of it.
    """
    starts = [(runs[i], runs[i + 1]) for i in range(0, len(runs) - 2, 2)]
    low = starts[0][0] - min(reach, *starts[0])
    starts = starts[:1] + [_change(one, two, a, b) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    parts = []
    for n, (x, y) in enumerate(starts):
        first = low if n == 0 else x
        last = starts[n + 1][0] if n + 1 < len(starts) else len(one)
        if n + 1 == len(starts):
            last = min(last, runs[-2] + reach)
        last = min(last, len(two) - y + x, len(one))
        if last > first:
            parts.append((first, last, y - x))
    place = np.concatenate([np.arange(a, b) for a, b, _ in parts])
    there = np.concatenate([np.arange(a, b) + d for a, b, d in parts])
    same = one[place] == two[there]
    if same.sum() < alike * min_words - 1e-9:
        return []  # a stretch has this share of equal words
    worth = np.where(same, 1 - alike, -alike)
    at = 0
    for (a, b, d), (_, _, e) in zip(parts[:-1], parts[1:], strict=True):
        at += b - a
        worth[at] -= abs(d - e) * alike
    return [(int(place[a]), int(place[b - 1]) + 1, int(there[a]), int(there[b - 1]) + 1, int(same[a:b].sum()))
            for a, b in _long_enough(worth, same, min_words)]


def _long_enough(worth: np.ndarray, same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """``stretches`` of ``least`` words or more, and between them such whose sum is not below 0, from equal word to equal word.

    The sum of a passage with many edits is greatest on a shorter part of it. One of twice ``least`` words has a half that will do.
    """
    total = np.concatenate([[0.0], np.cumsum(worth)])
    out = [(a, b) for a, b in stretches(worth) if b - a >= least]
    edge = [0, *(x for pair in out for x in pair), len(worth)]
    todo = list(zip(edge[::2], edge[1::2], strict=True))
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least:
            continue
        # ends[i]: the sum up to lo + least + i, if a stretch may end there.
        ends = np.where(same[lo + least - 1:hi], total[lo + least:hi + 1], -np.inf)
        reach = np.concatenate([ends, np.full(least, -np.inf)])
        gain = _sliding(reach, least + 1, np.maximum) - total[lo:hi - least + 1]
        gain = np.where(same[lo:hi - least + 1], gain, -np.inf)
        a = int(gain.argmax())
        if gain[a] < -1e-9:
            continue
        b = lo + least + a + int(reach[a:a + least + 1].argmax())
        out.append((lo + a, b))
        todo += [(lo, lo + a), (b, hi)]
    return out


def stretches(worth: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the stretch with the greatest sum, and so on left and right of it while there are sums above 0.

    Ruzzo and Tompa's way: one pass over the runs of gains; a run joins an earlier stretch that starts lower and ends lower.
    """
    total = np.concatenate([[0.0], np.cumsum(worth)])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (worth > 0).astype(np.int8), [0]])))
    held: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum at the end, the last that starts lower
    for first, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        low, high, at = total[first], total[end], len(held) - 1
        while True:
            while at >= 0 and held[at][2] >= low:
                at = held[at][4]
            if at < 0 or held[at][3] >= high:
                held.append((first, end, low, high, at))
                break
            first, _, low, _, former = held[at]
            del held[at:]
            at = former
    return [(first, end) for first, end, *_ in held]


def _change(one: np.ndarray, two: np.ndarray, old: tuple[int, int], new: tuple[int, int]) -> tuple[int, int]:
    """Where to enter the diagonal of ``new`` on the way from ``old``."""
    x = np.arange(old[0], new[0])
    before, after = x - old[0] + old[1], x - new[0] + new[1]
    stay = (before < len(two)) & (one[x] == two[np.minimum(before, len(two) - 1)])
    go = (after >= 0) & (one[x] == two[np.maximum(after, 0)])
    # Words before the change count on the old diagonal, the others on the new one.
    equal = np.concatenate([[0], np.cumsum(stay)]) + np.concatenate([np.cumsum(go[::-1])[::-1], [0]])
    at = old[0] + len(x) - int(equal[::-1].argmax())
    return at, at - new[0] + new[1]


def _aligned(min_words: int, alike: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None, None)
        for batch in batches:
            rows = []
            for doc, home, runs, text, other in zip(*(batch.column(i) for i in range(5)), strict=True):
                text, other = (x.as_buffer() or pa.py_buffer(b"") for x in (text, other))
                if held[0] is None or not held[0].equals(other):  # rows come sorted by home
                    there = _Words(other)
                    held = (other, there, there.hashes(0, len(there.first)))
                _, there, there_hashes = held
                own, runs = _Words(text), runs.as_py()
                if runs[-2] >= len(own.first) or max(runs[1::2]) >= len(there_hashes):
                    continue  # another row's text under a repeated id
                # Only words within reach of the chain are looked at.
                low = runs[0] - min(REACH, runs[0], runs[1])
                hashes = own.hashes(low, runs[-2] + REACH)
                near = [v - low if i % 2 == 0 else v for i, v in enumerate(runs)]
                for a, b, c, d, equal in align(hashes, there_hashes, near, alike, min_words):
                    if b - a >= min_words and equal >= alike * (b - a) - 1e-9:
                        rows.append((doc.as_py(), own.point(own.first[low + a]), own.point(own.last[low + b - 1]), home.as_py(),
                                     there.point(there.first[c]), there.point(there.last[d - 1]), b - a, equal))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows, strict=True)], _PASSAGE)

    return run


_PASSAGE = ["doc", "start", "stop", "home", "home_start", "home_stop", "n_words", "n_equal"]


class _Words:
    """Places of a text's words (UTF-8 bytes) and, on demand, their hashes and code points."""

    def __init__(self, text: pa.Buffer):
        self.data = np.frombuffer(text, np.uint8)
        self.first, self.last = spans(self.data, np.array([0, len(self.data)]))

    def hashes(self, lo: int, hi: int) -> np.ndarray:
        """Of words ``lo`` to ``hi`` (exclusive; beyond the last one: to the end)."""
        first, last = self.first[lo:hi], self.last[lo:hi]
        if not len(first):
            return np.zeros(0, np.uint64)
        return word_hashes(self.data[first[0]:last[-1]], first - first[0], last - first[0])

    def point(self, byte: int) -> int:
        """Code points before ``byte``."""
        return int(np.count_nonzero((self.data[:byte] & 0xC0) != 0x80))


def passages(docs: DataFrame, id: str, text: str, min_words: int = MIN_WORDS, alike: float = ALIKE) -> DataFrame:
    """doc, start, stop, home, home_start, home_stop, n_words, n_equal: stretches of ``min_words`` words or more of a document
    that an earlier one (home, smaller id) also has, with a share of ``alike`` or more equal words in line.

    Places count code points, stops are exclusive. A document may meet several homes, and a home may itself repeat an
    earlier document: the first document of a passage is never reported for it. Null texts are empty; rows with a null id
    are left out; rows that share an id are one document and not compared with each other; other columns are ignored. An
    empty table gives an empty one. Repeats inside one document are not looked for.
    """
    width, window = WIDTH, WINDOW
    found = matches(docs, id, text, width, window, min_words)
    linked = cut_lineage(
        found.select("doc", "home", "pos", "home_pos").repartition("doc", "home")
        .sortWithinPartitions("doc")
        .mapInArrow(_chained(width), "doc bigint, home bigint, runs array<bigint>"))
    # Only texts of such documents are dealt, once for both sides.
    ids = linked.select(F.col("doc").alias("_id")).union(linked.select("home")).distinct()
    texts = docs.select(docs[id].cast("long").alias("_id"), docs[text].alias("_text")).join(
        F.broadcast(ids) if 2 * linked.count() <= BROADCAST_IDS else ids, "_id", "left_semi")
    own = texts.select(F.col("_id").alias("doc"), F.col("_text").alias("_one"))
    other = texts.select(F.col("_id").alias("home"), F.col("_text").alias("_two"))
    return (
        linked.join(own, "doc").join(other, "home").select("doc", "home", "runs", "_one", "_two")
        .mapInArrow(_aligned(min_words, alike), ", ".join(f"{c} bigint" for c in _PASSAGE)).distinct()
    )


def cover(found: DataFrame, doc: str = "doc") -> DataFrame:
    """Per document the merged (start, stop) stretches of its passages, ``cuts``, sorted."""
    w = W.partitionBy(doc).orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1))
    opened = found.select(doc, "start", "stop", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0).alias("_n"))
    merged = opened.withColumn("_n", F.sum("_n").over(w)).groupBy(doc, "_n").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"))
    return merged.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cuts"))


def remove_passages(docs: DataFrame, id: str, text: str, length: str | None = None, min_words: int = MIN_WORDS,
                    alike: float = ALIKE) -> DataFrame:
    """``docs`` without the passages that earlier documents have; rows of which only white space is left go.

    All other rows and all columns stay; ``length`` names a column that is set to the new number of code points where a text
    changes.
    """
    cuts = cover(passages(docs, id, text, min_words, alike))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def cut(s, x):
        gap = F.substring(F.col("_text"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        return F.struct(x["stop"].alias("at"), F.concat(s["out"], gap).alias("out"))

    rest = lambda s: F.concat(s["out"], F.substr(F.col("_text"), (s["at"] + 1).cast("int")))
    # The caller's other columns travel in one, so none can have the name of an inner one.
    own = docs.select(docs[id].cast("long").alias("doc"), docs[text].alias("_text"),
                      F.struct(*[docs[c] for c in docs.columns if c != text]).alias("_rest"))
    out = own.join(cuts, "doc", "left").withColumn(
        "_new", F.when(F.col("cuts").isNotNull(), F.aggregate("cuts", state, cut, rest)))
    out = out.where(F.col("_new").isNull() | F.col("_new").rlike(r"[^ \t-\r]"))
    result = {c: F.col("_rest").getField(c) for c in docs.columns if c != text} | {text: F.coalesce("_new", "_text")}
    if length:
        result[length] = F.coalesce(F.length("_new").cast(docs.schema[length].dataType), result[length])
    return out.select(*[result[c].alias(c) for c in docs.columns])
