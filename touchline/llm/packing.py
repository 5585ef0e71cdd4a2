"""Best-fit-decreasing packing of token pieces into fixed-size sequences.

Which sequence a piece gets depends on its length only, so best fit runs over the counts of the at most ``size`` lengths.
Open sequences are runs of equal remaining capacity, and a segment tree over capacities finds the tightest that fits. The
outcome is a table of runs; every piece finds its place in it by its rank among pieces of its length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.llm.arrow_text import blocks, column, spans
from touchline.llm.token_counts import Remembered
from touchline.session import cut_lineage

#: Shares of one length that are ranked apart, so that a length that many pieces have is no single task.
SHARES = 1024
#: Distinct words, without case and end sign, whose ids a task remembers.
CORES = 300_000
#: Bytes of texts whose words are told apart together; a longer text makes a block of its own.
ENCODED_BYTES = 1 << 22


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Ids of words (no white space inside) by a vocabulary that drops white space and ignores case.

    A word of Latin-1 letters with at most one end sign is two pre-tokens: its lower-case letters, which go straight to
    the library's merges as their byte signs, and the sign. All others go through the whole library.
    """

    PLAIN, SIGNS = r"\A[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?]?\z", ".,;:!?"

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = _tokenizer(path)
        self.merges = self.library.model.tokenize
        probe = lambda s: self.library.encode(s, add_special_tokens=False).ids
        if probe(" a \n b\t") != probe("a") + probe("b") or probe("ÀBc,") != probe("àbc") + probe(","):
            raise ValueError("this vocabulary does not drop white space, ignore case and part signs")
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = [array("I", probe(s)).tobytes() for s in self.SIGNS]
        self.sign_of = np.full(256, len(self.SIGNS))  # by last byte; the last one is no sign
        self.sign_of[list(self.SIGNS.encode())] = range(len(self.SIGNS))
        self.bytes = {i: as_bytes.pre_tokenize_str(chr(i))[0][0] for i in range(0xC0, 0x100)}
        self.core = Remembered(self._encode, CORES)

    def _encode(self, words: list[str]) -> list[bytes]:
        """``words``: lower-case letters of Latin-1, or, after a space, any word."""
        merges = self.merges
        out = [b"" if w[0] == " "
               else array("I", [t.id for t in merges(w if w.isascii() else w.translate(self.bytes))]).tobytes()
               for w in words]
        rest = [i for i, w in enumerate(words) if w[0] == " "]
        rows = self.library.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)
        for i, row in zip(rest, rows, strict=True):
            out[i] = array("I", row.ids).tobytes()
        return out

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``words`` (large strings, none empty) one after another, and how many each has."""
        plain = pc.match_substring_regex(words, self.PLAIN)
        none, space = pa.scalar("", words.type), pa.scalar(" ", words.type)
        cores = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(words, self.SIGNS)), pc.binary_join_element_wise(none, words, space))
        cores = cores.dictionary_encode()
        found = [*self.core(cores.dictionary.to_pylist()), *self.signs, b""]
        _, offsets, data = words.buffers()
        ends = np.frombuffer(offsets, np.int64)[words.offset + 1:words.offset + len(words) + 1]
        sign = np.where(plain, self.sign_of[np.frombuffer(data, np.uint8)[ends - 1]], len(self.signs))
        # Every word is a core and a sign, which may have no ids.
        parts = np.stack([cores.indices.to_numpy(), sign + len(cores.dictionary)], axis=1)
        flat, n = ragged(found, parts.ravel())
        return flat, n.reshape(-1, 2).sum(axis=1)

    def __call__(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        flat, n = self.ids(pa.array(words, pa.large_string()))
        return [part.tobytes() for part in np.split(flat, np.cumsum(n)[:-1])]


def ragged(rows: list[bytes], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers of ``rows[i]`` for each i of ``which``, one after another, and how many each has."""
    n = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
    return gathered(np.frombuffer(b"".join(rows), np.uint32), n, which)


def gathered(flat: np.ndarray, n: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``ragged``, of rows of ``n`` numbers that lie one after another in ``flat``."""
    size = n[which]
    skip = (np.cumsum(n) - n)[which] - (np.cumsum(size) - size)
    return flat[np.repeat(skip, size) + np.arange(size.sum())], size


def _known(path: str) -> WordIds:
    """For one task: what it remembers goes with it, as other steps use the same worker."""
    return WordIds(path)


def cut_into_pieces(docs: DataFrame, id: str, text: str, path: str, size: int = 4096, end_id: int = 1,
                    keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): the ids of each row's whole text and ``end_id``, cut after every
    ``size`` ids.

    Null texts are empty (one piece of one id). Rows are handled one by one, whatever their id. Nothing is shuffled.
    """
    key = docs.schema[id].dataType.simpleString()
    names = [id, "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(path)
        for batch in batches:
            for row, data, offsets in blocks(column(batch, "_text"), ENCODED_BYTES):
                ids, ends = _text_ids(data, offsets, known, end_id)
                lengths = np.diff(ends, prepend=0)
                cuts = -(-lengths // size)
                owner = np.repeat(np.arange(len(lengths)), cuts)
                piece = np.arange(len(owner)) - (np.cumsum(cuts) - cuts)[owner]
                start = piece * size
                length = np.minimum(lengths[owner] - start, size)
                at = (ends - lengths)[owner] + start
                raw = [ids[a:b] for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row + owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                     pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                     *[pa.array([r.tobytes() for r in raw], pa.binary())] * keep_ids], names)

    return docs.select(docs[id].alias("_id"), docs[text].alias("_text")).mapInArrow(
        run, f"`{id}` {key}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids)


def _text_ids(data: np.ndarray, offsets: np.ndarray, known: WordIds, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a block's texts one after another, each with ``end_id``, and where each text's ids end.

    Texts are split at ASCII white space, which all definitions of it share; a word is looked up once a block.
    """
    first, last = spans(data, offsets)
    size = last - first
    bounds = np.concatenate([[0], np.cumsum(size)])
    # The words' bytes without what lies between them.
    step = np.zeros(len(data) + 1, np.int8)
    step[first] = 1
    step[last] -= 1
    packed = data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    found = pa.Array.from_buffers(
        pa.large_string(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(packed)]).dictionary_encode()
    flat, n = known.ids(found.dictionary) if len(size) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    # A text's end counts as one more word.
    at = np.searchsorted(first, offsets[1:])
    which = np.insert(found.indices.to_numpy().astype(np.int64), at, len(n))
    ids, size = gathered(np.append(flat, np.uint32(end_id)), np.append(n, 1), which)
    return ids, np.cumsum(size)[at + np.arange(len(at))]


_NOT_ASCII_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -​    　]")


def _words(text: str) -> list[str]:
    """The text between white space. Signs that two definitions of white space may judge apart keep the text whole there:
    it is split at ASCII white space only, which all definitions share."""
    return re.split("[ \t\n\x0b\x0c\r]+", text.strip(" \t\n\x0b\x0c\r")) if _NOT_ASCII_SPACE.search(text) else text.split()


class _Open:
    """Runs of open sequences by remaining capacity; a segment tree holds which capacities have any."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = np.zeros(2 * self.leaves, bool)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, first: int, n: int) -> None:
        if n and capacity:
            self.runs[capacity].append((first, n))
            self._mark(capacity, True)

    def take(self, capacity: int) -> tuple[int, int]:
        run = self.runs[capacity].pop()
        if not self.runs[capacity]:
            self._mark(capacity, False)
        return run

    def _mark(self, capacity: int, value: bool) -> None:
        node = capacity + self.leaves
        self.tree[node] = value
        while node > 1:
            node //= 2
            self.tree[node] = self.tree[2 * node] or self.tree[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of ``least`` or more that has an open sequence."""
        node = least + self.leaves
        if self.tree[node]:
            return least
        while node > 1 and (node & 1 or not self.tree[node + 1]):
            node //= 2
        if node <= 1:
            return None
        node += 1
        while node < self.leaves:
            node = 2 * node + (not self.tree[2 * node])
        return node - self.leaves


def best_fit_runs(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, first sequence, pieces per sequence, first offset) of runs of pieces.

    The piece of rank r (from 0) of a length lies in the run with the last first rank <= r, d = r - first rank places in:
    in sequence ``first sequence + d // per``, at ``first offset + (d % per) * length``. As the tightest sequence stays
    the tightest until a length no longer fits, a run fills each sequence before the next.
    """
    open_, runs, made = _Open(size), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = open_.tightest(length)
            if capacity is None:
                capacity, first, n = size, made, -(-left // (size // length))
                made += n
            else:
                first, n = open_.take(capacity)
            per = capacity // length
            put = min(left, n * per)
            full, rest = divmod(put, per)
            runs.append((length, rank, first, per, size - capacity))
            open_.add(capacity - per * length, first, full)
            if rest:
                open_.add(capacity - rest * length, first + full, 1)
            open_.add(capacity, first + full + bool(rest), n - full - bool(rest))
            left -= put
            rank += put
    return runs


def pack(pieces: DataFrame, length: str = "length", size: int = 4096, order: tuple[str, ...] = ()) -> DataFrame:
    """``pieces`` with sequence_id and offset: gapless places in sequences of ``size`` at most, by best fit decreasing.

    ``pieces`` should be a stored table, for it is read twice. ``order`` names the columns that identify a piece. Lengths
    must be 1..``size`` (else the job fails); equal rows are pieces of their own. The driver gets one row per length.
    """
    spark = pieces.sparkSession
    # Counts come sorted from one row per (length, share); a length's pieces are ranked share by share.
    order = order or tuple(pieces.columns)
    # The caller's columns travel in one, so none can have the name of an inner one.
    shared = pieces.select(F.struct(*[pieces[c] for c in pieces.columns]).alias("_piece"), pieces[length].alias("_length"),
                           F.pmod(F.xxhash64(*[pieces[c] for c in order]), F.lit(SHARES)).alias("_share"))
    counted = shared.groupBy("_length", "_share").agg(F.count("*").alias("_n"))
    totals = {r[0]: r[1] for r in counted.groupBy("_length").agg(F.sum("_n")).collect()}
    if any(n is None or not 1 <= n <= size for n in totals):
        raise ValueError(f"lengths must be 1 to {size}")
    runs = np.array(best_fit_runs(totals, size), np.int64).reshape(-1, 5)
    borders = [0, *np.flatnonzero(np.diff(runs[:, 0])) + 1, len(runs)]
    where = {int(runs[a, 0]): (int(a), int(b)) for a, b in zip(borders[:-1], borders[1:], strict=True) if b > a}
    plan = spark.sparkContext.broadcast((runs, where))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        runs, where = plan.value
        out = np.zeros((len(length), 2), np.int64)
        values, ranks = length.to_numpy(), rank.to_numpy()
        order = np.argsort(values, kind="stable")
        cuts = [0, *np.flatnonzero(np.diff(values[order])) + 1, len(order)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            rows = order[lo:hi]
            if not len(rows):
                continue
            n = int(values[rows[0]])
            a, b = where[n]
            run = runs[a + np.searchsorted(runs[a:b, 1], ranks[rows], side="right") - 1]
            deep = ranks[rows] - run[:, 1]
            out[rows, 0] = run[:, 2] + deep // run[:, 3]
            out[rows, 1] = run[:, 4] + deep % run[:, 3] * n
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    before = W.partitionBy("_length").orderBy("_share").rowsBetween(W.unboundedPreceding, -1)
    skips = counted.select("_length", "_share", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    inside = W.partitionBy("_length", "_share").orderBy(*[F.col("_piece").getField(c) for c in order])
    return (
        shared.withColumn("_in", F.row_number().over(inside) - 1)
        .join(skips, ["_length", "_share"])
        .withColumn("_place", place(F.col("_length"), F.col("_skip") + F.col("_in")))
        .select(*[F.col("_piece").getField(c).alias(c) for c in pieces.columns], "_place.sequence_id", "_place.offset")
    )


def pack_documents(docs: DataFrame, id: str, text: str, path: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """Whole ``docs`` as pieces with their places; see ``cut_into_pieces`` and ``pack``.

    Pieces are stored once in the shared checkpoint folder (about 40 bytes each), as texts are encoded only once. Rows
    that repeat an id are packed each; an empty table gives an empty one.
    """
    pieces = cut_lineage(cut_into_pieces(docs, id, text, path, size, end_id))
    return pack(pieces, "length", size, (id, "piece", "ids_crc32"))
