"""Offset-preserving encoding into pieces, and decoding.

A text is normalised by the longest prefixes that the vocabulary's compiled character map knows. The source position of
every normalised byte is kept, so each piece is projected back to a span of the original bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from touchline.llm.arrow_text import column
from touchline.llm.token_counts import SPACE, Remembered, grouped, merger


#: Rows that a task decodes before it hands them on.
DECODED = 500


class CharacterMap:
    """Longest-prefix replacement by a compiled map: a double-array trie, then its replacement texts.

    Fixed format: a 32-bit byte count of the trie, its 32-bit units, zero-ended texts. A unit holds its label in the
    low 8 bits, a leaf flag in bit 8, and an offset from bit 10 on, shifted by 8 more if bit 9 is set; a leaf's value is
    its low 31 bits.
    """

    def __init__(self, blob: bytes):
        size = int(np.frombuffer(blob[:4], np.uint32)[0])
        self.units = np.frombuffer(blob[4:4 + size], np.uint32).tolist()
        self.texts = blob[4 + size:]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest known prefix of ``data`` from ``at`` on."""
        units, found = self.units, None
        node = self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            leaf = units[node] >> 8 & 1
            node ^= self._offset(units[node])
            if leaf:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.texts[found[1]:self.texts.index(b"\0", found[1])]


class Normaliser:
    """A vocabulary's normalisation: character map, extra spaces, leading space, space signs."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix = spec.add_dummy_prefix
        self.squeeze = spec.remove_extra_whitespaces
        self.sign = SPACE if spec.escape_whitespaces else " "
        self.plain = self.map is None and not self.squeeze

    def text(self, text: str) -> str:
        """The normalised text alone."""
        if self.plain:
            return (self.sign if self.prefix else "") + text.replace(" ", self.sign) if text else ""
        return self.aligned(text)[0]

    def aligned(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the original byte it stems from."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int64)
        if self.plain:
            raw, sign = np.frombuffer(data, np.uint8), len(self.sign.encode())
            wide = np.where(raw == 32, sign, 1)
            lead = np.zeros(sign * self.prefix, np.int64)
            return self.text(text), np.concatenate([lead, np.repeat(np.arange(len(raw)), wide), [len(raw)]])
        parts: list[tuple[int, bytes]] = []
        at, last = 0, len(data)
        while at < last:
            size, put = self._step(data, at)
            parts.append((at, put))
            at += size
        end = last
        if self.squeeze:
            while parts and parts[0][1].strip(b" ") == b"":
                parts.pop(0)
        if not parts:
            return "", np.zeros(1, np.int64)
        sign = self.sign.encode()
        out, source, spaced = bytearray(), [], self.squeeze
        if self.prefix:
            out += sign
            source += [parts[0][0]] * len(sign)
        for start, put in parts:
            if spaced:
                put = put.lstrip(b" ")
            for byte in put:
                add = sign if byte == 32 else bytes([byte])
                out += add
                source += [start] * len(add)
            if put:
                spaced = self.squeeze and put.endswith(b" ")
        if self.squeeze:
            while out.endswith(sign) and len(out) > 0:
                del out[-len(sign):]
                end = source[len(out)]
                del source[len(out):]
        return out.decode(), np.array([*source, end], np.int64)

    def _step(self, data: bytes, at: int) -> tuple[int, bytes]:
        found = self.map.longest(data, at) if self.map else None
        if found:
            return found
        lead = data[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return size, data[at:at + size]


@lru_cache(maxsize=2)
def normaliser(path: str) -> Normaliser:
    return Normaliser(merger(path).spec)


@lru_cache(maxsize=2)
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def _known(path: str) -> Remembered:
    model = merger(path)
    return Remembered(lambda tokens: [x.tobytes() for x in model.encode(tokens)])


@lru_cache(maxsize=2)
def _byte_sizes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes that each id stands for, its piece's or 1 for an id of a single byte; and how many of them are space
    signs."""
    library, model = _library(path), merger(path)
    pieces = [library.id_to_piece(i) for i in range(model.vocabulary)]
    sizes = np.array([len(p.encode()) for p in pieces])
    sizes[model.byte_ids] = 1
    return sizes, np.array([p.count(SPACE) for p in pieces])


def _places(normal: Normaliser, sizes: tuple[np.ndarray, np.ndarray], text: str, ids: np.ndarray) -> np.ndarray:
    """The original byte at which each id's share of the text begins, and the text's end.

    Where normalisation only writes spaces as signs, the alignment is plain sums: a sign stands for one byte, the leading one
    for none. Else it is looked up in the text's alignment.
    """
    whole, signs = sizes
    edges = np.zeros(len(ids) + 1, np.int64)
    if normal.plain and normal.sign == SPACE and SPACE not in text:
        np.cumsum((whole - (len(SPACE.encode()) - 1) * signs)[ids], out=edges[1:])
        edges[1:] -= normal.prefix and len(ids) > 0
        return edges
    np.cumsum(whole[ids], out=edges[1:])
    return normal.aligned(text)[1][edges]


def encode(docs: DataFrame, id: str, text: str, path: str, ends: bool = True) -> DataFrame:
    """Per row: id, ids (little-endian unsigned 32-bit), spans (start and end byte of every id's share of the text, as
    such numbers too).

    Ids are the vocabulary library's, with begin and end ids if ``ends``; those have empty spans at the text's ends. The
    leading space that normalisation adds has no bytes of its own. A null text counts as empty; ids of rows may be null
    or repeat; other columns are ignored. Nothing is shuffled, and a task holds about a million characters at a time.
    """
    key = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, normal, sizes = merger(path), normaliser(path), _byte_sizes(path)
        known, library = _known(path), _library(path)
        begin = np.array([library.bos_id()] * ends, np.uint32)
        end = np.array([library.eos_id()] * ends, np.uint32)
        for batch in batches:
            done = 0
            for group in grouped(t.as_py() for t in column(batch, "_text")):
                parts = [model.pretokens(normal.text(t)) for t in group]
                found = known([t for p in parts for t in p])
                at, ids, spans = 0, [], []
                for p, t in zip(parts, group, strict=True):
                    own = np.frombuffer(b"".join(found[at:at + len(p)]), np.uint32)
                    at += len(p)
                    place = _places(normal, sizes, t, own)
                    span = np.empty((len(own) + 2 * ends, 2), np.uint32)
                    span[ends:len(own) + ends, 0], span[ends:len(own) + ends, 1] = place[:-1], place[1:]
                    if ends:
                        span[0], span[-1] = 0, place[-1]
                    ids.append(np.concatenate([begin, own, end]).tobytes())
                    spans.append(span.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(group)), pa.array(ids, pa.binary()), pa.array(spans, pa.binary())],
                    [id, "ids", "spans"])
                done += len(group)

    return docs.select(docs[id].alias("_id"), docs[text].alias("_text")).mapInArrow(
        run, f"`{id}` {key}, ids binary, spans binary")


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text that the vocabulary's library decodes from each row's ``ids`` (null: null) in ``out``."""
    from pyspark.sql.types import StringType, StructField, StructType

    names = [c for c in encoded.columns if c != out]
    encoded = encoded.select(*[encoded[c] for c in names])
    schema = StructType([*encoded.schema.fields, StructField(out, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library(path)
        for whole in batches:
            for at in range(0, whole.num_rows, DECODED):
                batch = whole.slice(at, DECODED)
                texts = [None if not x.is_valid else library.decode(np.frombuffer(x.as_buffer(), np.uint32).tolist())
                         for x in batch.column(names.index(ids))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, out])

    return encoded.mapInArrow(run, schema)
