"""Token counts of piece (byte-fallback BPE) vocabularies by rank-synchronous merging of ragged numpy arrays.

Pre-tokens of many texts are held as one array of symbols. In every step each pre-token applies its own lowest-rank pair,
all at once; what remains are its pieces. Results of pre-tokens are kept in a bounded table per worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from touchline.llm.arrow_text import column

#: The sign that stands for a space in pieces.
SPACE = "▁"
#: Distinct pre-tokens that a worker remembers.
REMEMBERED = 400_000
#: Symbols merged at once.
BATCH_SYMBOLS = 200_000
NONE = np.int32(2**31 - 1)


class PieceMerger:
    """Merges of one vocabulary file, as arrays.

    Pairs are looked up by (left symbol, right symbol). Their rank is the order of the merged piece's score, best first.
    All places of a pre-token's best pair are merged at once where no piece that a merge opens can rank before it
    (``alone`` is false); else only the leftmost is, so the outcome equals one merge at a time, leftmost first.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
            raise ValueError("a BPE vocabulary with byte fallback is needed")
        if any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.spec = model.normalizer_spec
        pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.byte_ids = np.zeros(256, np.uint32)
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte_ids[int(p.piece[3:5], 16)] = i
        self.vocabulary = len(model.pieces)
        # Characters that occur only inside longer pieces get symbols after the vocabulary.
        extra = sorted({c for p in pieces for c in p} - pieces.keys())
        symbols = pieces | {c: self.vocabulary + i for i, c in enumerate(extra)}
        self.unknown = self.vocabulary + len(extra)
        self.characters = {c: i for c, i in symbols.items() if len(c) == 1}
        scores = np.array([p.score for p in model.pieces])
        _, rank = np.unique(-scores, return_inverse=True)
        keys, ranks, merged = [], [], []
        alone = np.zeros(self.vocabulary, bool)
        tied = np.bincount(rank[list(pieces.values())], minlength=len(scores)) > 1
        for piece, i in pieces.items():
            alone[i] |= tied[rank[i]]
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ranks.append(rank[i])
                    merged.append(i)
                    for part in (left, right):
                        if part < self.vocabulary and rank[i] <= rank[part]:
                            alone[part] = True
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.int64(2**62))
        self.ranks = np.append(np.array(ranks, np.int32)[order], NONE)
        self.merged = np.append(np.array(merged, np.int32)[order], np.int32(0))
        self.alone = alone
        # Before a space sign a text may be cut if no piece has one after another character.
        self.cuts_at_space = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in the table; the last entry means none."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def merge(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols of all tokens one after another, and how many each token has."""
        code = self.characters
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        symbol = np.fromiter((code.get(c, self.unknown) for t in tokens for c in t), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(tokens)), sizes)
        done_symbol, done_owner = [], []
        last = len(self.keys) - 1
        pair = np.full(len(symbol), last, np.int64)
        if len(symbol) > 1:
            inner = np.flatnonzero(owner[:-1] == owner[1:])
            pair[inner] = self._pairs(symbol[inner], symbol[inner + 1])
        while len(symbol):
            rank = self.ranks[pair]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, first)
            counts = np.diff(np.r_[first, len(symbol)])
            ended = best == NONE
            if ended.all():
                done_symbol.append(symbol)
                done_owner.append(owner)
                break
            if ended.sum() * 4 >= len(ended):
                gone = np.repeat(ended, counts)
                done_symbol.append(symbol[gone])
                done_owner.append(owner[gone])
                symbol, owner, pair, rank = symbol[~gone], owner[~gone], pair[~gone], rank[~gone]
                best, counts = best[~ended], counts[~ended]
            hit = (rank == np.repeat(best, counts)) & (rank != NONE)
            at = np.flatnonzero(hit)
            # A run of places next to each other (x x x) merges every other pair, from the left.
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            new = self.merged[pair[at]]
            leftmost = np.r_[True, owner[at[1:]] != owner[at[:-1]]]
            take = leftmost | ~self.alone[new]
            at, new = at[take], new[take]
            symbol[at] = new
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            symbol, owner, pair = symbol[keep], owner[keep], pair[keep]
            at = place[at]
            for side in (at, at[at > 0] - 1):
                fits = side[side + 1 < len(symbol)]
                pair[side] = last
                fits = fits[owner[fits] == owner[fits + 1]]
                pair[fits] = self._pairs(symbol[fits], symbol[fits + 1])
        if not done_symbol:
            return np.zeros(0, np.int64), np.zeros(len(tokens), np.int64)
        symbol, owner = np.concatenate(done_symbol), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbol[order], np.bincount(owner, minlength=len(tokens))

    def encode(self, tokens: list[str]) -> list[np.ndarray]:
        """Ids of every token; characters without a piece become the ids of their bytes."""
        out: list[np.ndarray] = []
        for part in self._batches(tokens):
            symbol, counts = self.merge(part)
            ends = np.cumsum(counts)
            bad = np.flatnonzero(symbol >= self.vocabulary)
            ids = symbol.astype(np.uint32)
            strange = set(np.searchsorted(ends, bad, side="right").tolist())
            for i, (lo, hi) in enumerate(zip(ends - counts, ends, strict=True)):
                out.append(self._spell(part[i], symbol[lo:hi]) if i in strange else ids[lo:hi])
        return out

    def count(self, tokens: list[str]) -> list[int]:
        """Number of ids of every token."""
        out: list[int] = []
        for part in self._batches(tokens):
            symbol, counts = self.merge(part)
            owner = np.repeat(np.arange(len(part)), counts)
            strange = np.unique(owner[symbol >= self.vocabulary])
            ends = np.cumsum(counts)
            for i in strange:
                counts[i] = len(self._spell(part[i], symbol[ends[i] - counts[i]:ends[i]]))
            out += counts.tolist()
        return out

    def _spell(self, token: str, symbol: np.ndarray) -> np.ndarray:
        """Symbols with no piece of their own stand for one character each: replace them by byte ids."""
        out, at, sizes = [], 0, self.sizes
        for s in symbol.tolist():
            if s < self.vocabulary:
                out.append(np.array([s], np.uint32))
                at += sizes[s]
            else:
                out.append(self.byte_ids[np.frombuffer(token[at].encode(), np.uint8)])
                at += 1
        return np.concatenate(out)

    @property
    def sizes(self) -> list[int]:
        """Characters of every normal piece."""
        if not hasattr(self, "_sizes"):
            lengths = {i: 1 for i in range(self.vocabulary)}
            for left_right, i in zip(self.keys[:-1].tolist(), self.merged[:-1].tolist(), strict=True):
                lengths.setdefault(i, 0)
                lengths[i] = (left_right >> 32, left_right & 0xFFFFFFFF)
            resolved: dict[int, int] = {}

            def size(s: int) -> int:
                if s not in resolved:
                    parts = lengths.get(s, 1)
                    resolved[s] = parts if isinstance(parts, int) else size(parts[0]) + size(parts[1])
                return resolved[s]

            self._sizes = [size(i) for i in range(self.vocabulary)]
        return self._sizes

    def _batches(self, tokens: list[str]) -> Iterator[list[str]]:
        part, size = [], 0
        for t in tokens:
            part.append(t)
            size += len(t)
            if size >= BATCH_SYMBOLS:
                yield part
                part, size = [], 0
        if part:
            yield part

    def pretokens(self, normal: str) -> list[str]:
        """Parts of a normalised text that no merge can join: runs of space signs with what follows."""
        if not normal:
            return []
        if not self.cuts_at_space:
            return [normal]
        parts = normal.split(SPACE)
        if "" not in parts[1:]:
            return ([parts[0]] if parts[0] else []) + [SPACE + p for p in parts[1:]]
        return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", normal)


@lru_cache(maxsize=2)
def merger(path: str) -> PieceMerger:
    return PieceMerger(path)


class Remembered:
    """A bounded table of results per token; misses are computed together, once each.

    It has two halves: when the young one is full it becomes the old one, and what is asked for again moves over.
    """

    def __init__(self, compute, limit: int = REMEMBERED):
        self.compute, self.half, self.young, self.old = compute, limit // 2, {}, {}

    def __call__(self, tokens: list[str]) -> list:
        out = list(map(self.young.get, tokens))
        if None in out:
            at = [i for i, v in enumerate(out) if v is None]
            missing = list(dict.fromkeys([tokens[i] for i in at]))
            fresh = dict(zip(missing, map(self.old.get, missing), strict=True))
            new = [t for t, v in fresh.items() if v is None]
            fresh.update(zip(new, self.compute(new), strict=True))
            for i in at:
                out[i] = fresh[tokens[i]]
            if len(self.young) + len(fresh) > self.half:
                self.old, self.young = self.young, {}
            self.young.update(fresh)
        return out


@lru_cache(maxsize=2)
def _counts(path: str) -> Remembered:
    return Remembered(merger(path).count)


def count_tokens(docs: DataFrame, id: str, text: str, path: str, limit: int = 4096) -> DataFrame:
    """Per row of ``docs``: id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of its whole text.

    Counts are those of the vocabulary's library without begin, end or other added ids. A null text counts as empty (0
    bytes, 0 tokens); ids may be null or repeat, every row gets its own result; other columns are ignored. Nothing is
    shuffled. A text's pre-tokens are held at once, and about a million characters of texts are handled together.
    """
    from touchline.llm.pieces import normaliser

    key = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, normal, counts = merger(path), normaliser(path), _counts(path)
        for batch in batches:
            texts = column(batch, "_text").to_pylist()
            tokens = []
            for group in grouped(texts):
                parts = [model.pretokens(normal.text(t)) for t in group]
                found = counts([t for p in parts for t in p])
                at = 0
                for p in parts:
                    tokens.append(sum(found[at:at + len(p)]))
                    at += len(p)
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array([n > limit for n in tokens], pa.bool_())], [id, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[id].alias("_id"), docs[text].alias("_text")).mapInArrow(
        run, f"`{id}` {key}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def grouped(texts: Iterable[str], limit: int = 1_000_000) -> Iterator[list[str]]:
    """Runs of whole texts of about ``limit`` characters."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group
