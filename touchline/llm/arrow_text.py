"""Text columns inside Arrow tasks: blocks of whole texts as bytes, words and their hashes as numpy arrays.

Words are maximal runs of bytes other than space and ``\\t``..``\\r``; A-Z count as a-z. A word's hash sums random 64-bit
values of its bytes times powers of an odd number (mod 2**64) and mixes the sum, so a block is hashed without a loop.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 19
_SEED = 20260101
_POWER = np.uint64(0x9E3779B97F4A7C15)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The text column with nulls as empty texts."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)), "")


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about ``limit`` bytes."""
    wide = pa.types.is_large_string(texts.type)
    if len(texts) == 0:
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, raw[at[row]:at[end]], at[row:end + 1] - at[row]
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Random value of each byte (upper case as lower case), and whether it separates words."""
    values = np.random.default_rng(_SEED).integers(0, 2**64, 256, np.uint64, endpoint=False)
    values[65:91] = values[97:123]
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return values, space


@lru_cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    inverse = np.uint64(pow(int(_POWER), -1, 2**64))
    out = []
    for base in (_POWER, inverse):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end byte of each word of a block."""
    _, space = _tables()
    apart = np.ones(len(data) + 2, bool)
    apart[1:-1] = space[data]
    # A word also ends where its text ends: mark borders between two adjoining non-space bytes.
    inside = ~apart
    starts = inside[1:-1] & apart[:-2]
    ends = inside[1:-1] & apart[2:]
    cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    starts[cuts] |= inside[1:-1][cuts]
    ends[cuts - 1] |= inside[1:-1][cuts - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the words of ``data`` that begin at ``first`` and end before ``last``."""
    values, _ = _tables()
    powers, inverses = _powers(max(20, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers[:len(data)], out=total[1:])
    return mix((total[last] - total[first]) * inverses[first])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte) of each word of a block, and the first word of each text (with the end added)."""
    first, last = spans(data, offsets)
    return word_hashes(data, first, last), first, last, np.searchsorted(first, offsets)


@lru_cache
def _odd(n: int) -> np.ndarray:
    return np.random.default_rng(_SEED + 1).integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of runs of ``width`` words; fewer words make one run whose hash also depends on their number."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(n, width)
    factors = _odd(width)
    out = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        out += hashes[j:n - size + 1 + j] * factors[j]
    return mix(out + np.uint64(width - size))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of every text of a block."""
    hashes, _, _, at = words(data, offsets)
    return [np.unique(shingles(hashes[lo:hi], width)) for lo, hi in zip(at[:-1], at[1:], strict=True)]
