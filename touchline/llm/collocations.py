"""Collocations by stripes: each first word keys a counter of what follows it.

A task counts a window of words into stripes: for a language and a first word, a counter whose entries are nothing (the
word alone), the next word, or the next two words. Stripes of one prefix are merged by adding their counters entry by
entry. One merged structure gives the extensions of a prefix (its entries), the prefix totals (the entries one word
shorter) and the most frequent extension that may subsume a phrase (the greatest entry below it).

A stripe is cut into shards by its next word, so that a word with countless followers is no single task's work; an entry
and its extensions share a shard. Counters are added by a hash aggregate inside the partitions the stripes were dealt
to, which spills where a counter outgrows memory. Words are compared as texts, never by hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.llm.arrow_text import column, mix
from touchline.session import cut_lineage

#: First words of phrases that a task counts at once; two words of look-ahead follow. Codes of words take 21 bits.
WINDOW = 1 << 19
#: Bytes of text of a language gathered before a window is counted, and rows of stripes handed on at once.
GATHERED, HANDED_ON = 3 << 20, 100_000
#: Parts of a stripe.
SHARDS = 32
NO_LANGUAGE = "und"
#: A counter travels as one text, a line per entry: the next words, and after a tab the count if it is not one. Neither
#: sign can be part of a word.
_STRIPE = "lang string, first string, shard int, entries string"
_SPACE, _TAB, _LINE = (pa.scalar(c, pa.large_string()) for c in " \t\n")
_BITS = np.int64(21)
_MASK = np.int64((1 << 21) - 1)


def _signs() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each byte: its lower case, whether it ends a word, whether it ends a piece."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    piece = np.zeros(256, bool)
    piece[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
    word = piece.copy()
    word[[32, 9]] = True
    return low, word, piece


def split_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of texts, and the number of the piece that each lies in; pieces end with their text."""
    low, word, piece = _signs()
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    inside = ~word[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(last - first)])
    words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(low[data[inside]]))
    return words, np.cumsum(piece[data], dtype=np.int64)[first] if len(first) else np.zeros(0, np.int64)


def _shards(words: pa.Array) -> np.ndarray:
    """A shard of each distinct word, the same in every task."""
    if len(words) == 0:
        return np.zeros(0, np.int64)
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[at[0]:at[-1]]
    values = mix(np.arange(1, 257, dtype=np.uint64))
    return (mix(np.add.reduceat(values[data], at[:-1] - at[0])) % np.uint64(SHARDS)).astype(np.int64)


def stripes(words: pa.Array, piece: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array]]:
    """(first words, shards, counters) of each window of ``words``."""
    for start in range(0, len(words), WINDOW):
        here = words.slice(start, WINDOW + 2).dictionary_encode()
        inside = piece[start:start + WINDOW + 2]
        size = min(WINDOW, len(words) - start)
        # Distinct words are numbered by shard, so that sorted codes run by first word, then shard, then next words.
        shard = _shards(here.dictionary)
        order = np.argsort(shard, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        known, shard = here.dictionary.take(pa.array(order)), shard[order]
        ids = number[here.indices.to_numpy()]
        lead = ids << (2 * _BITS)
        pairs = np.flatnonzero(inside[1:] == inside[:-1])
        pairs = pairs[pairs < size]
        triples = np.flatnonzero(inside[2:] == inside[:-2])
        triples = triples[triples < size]
        second = lead[pairs] | (ids[pairs + 1] + 1 << _BITS)
        third = lead[triples] | (ids[triples + 1] + 1 << _BITS) | (ids[triples + 2] + 1)
        codes, counts = np.unique(np.concatenate([lead[:size], second, third]), return_counts=True)
        one, two, three = codes >> (2 * _BITS), (codes >> _BITS & _MASK) - 1, (codes & _MASK) - 1
        part = np.where(two >= 0, shard[two], 0)
        cuts = np.flatnonzero((np.diff(one) != 0) | (np.diff(part) != 0)) + 1
        offsets = np.concatenate([[0], cuts, [len(codes)]])
        after = pc.fill_null(known.take(pa.array(two, mask=two < 0)), "")
        longer = three >= 0
        spaced = pc.if_else(pa.array(longer), pc.binary_join_element_wise(
            after, pc.fill_null(known.take(pa.array(three, mask=~longer)), ""), _SPACE), after)
        spaced = pc.if_else(pa.array(counts > 1), pc.binary_join_element_wise(
            spaced, pa.array(counts).cast(pa.large_string()), _TAB), spaced)
        counters = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), spaced), _LINE)
        yield known.take(pa.array(one[offsets[:-1]])), part[offsets[:-1]], counters


def _stripe_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts texts of one language together; also hands on each language's number of words, under no first word."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def count(lang: str) -> Iterator[pa.RecordBatch]:
        words, piece = split_words(held.pop(lang))
        del sizes[lang]
        yield rows(lang, pa.array([None], pa.large_string()), np.zeros(1), pa.array([f"\t{len(words)}"], pa.large_string()))
        for first, shard, counters in stripes(words, piece):
            for lo in range(0, len(first), HANDED_ON):
                yield rows(lang, first.slice(lo, HANDED_ON), shard[lo:lo + HANDED_ON], counters.slice(lo, HANDED_ON))

    def rows(lang: str, first: pa.Array, shard: np.ndarray, counters: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([lang] * len(first), pa.string()), first.cast(pa.string()), pa.array(shard.astype(np.int32)),
            counters.cast(pa.string())], ["lang", "first", "shard", "entries"])

    for batch in batches:
        for lang, text in zip(column(batch, "_lang").to_pylist(), column(batch, "_text"), strict=True):
            held.setdefault(lang, []).append(text.as_buffer().to_pybytes())
            sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1])
            if sizes[lang] >= GATHERED:
                yield from count(lang)
    for lang in list(held):
        yield from count(lang)


def phrase_counts(docs: DataFrame, text: str, lang: str, least: int) -> DataFrame:
    """lang, w1, w2, w3, n, longest: occurrences of every phrase of one to three words that occurs ``least`` times or more,
    per language, and those of a two-word phrase's most frequent extension by a third word (with ``least`` or more, else 0).

    The row with no w1 counts all words of a language. A null language is ``und``, null texts hold no words.
    """
    rows = docs.select(F.coalesce(docs[lang], F.lit(NO_LANGUAGE)).alias("_lang"), docs[text].alias("_text"))
    merged = (
        rows.mapInArrow(_stripe_rows, _STRIPE).repartition("lang", "first", "shard")
        .select("lang", "first", "shard", F.explode(F.split("entries", "\n")).alias("entry"))
        .selectExpr("lang", "first", "shard", "substring_index(entry, '\t', 1) as next",
                    "if(instr(entry, '\t') > 0, cast(substring_index(entry, '\t', -1) as bigint), 1L) as n")
        .groupBy("lang", "first", "shard", "next").agg(F.sum("n").alias("n"))
        .where((F.col("n") >= least) | F.col("first").isNull())
    )
    # A two-word phrase and its extensions lie in one shard, so this is no further shuffle.
    extensions = W.partitionBy("lang", "first", "shard", "w2")
    return merged.select(
        "lang", "first", "shard", F.expr("nullif(substring_index(next, ' ', 1), '')").alias("w2"),
        F.expr("if(instr(next, ' ') > 0, substring_index(next, ' ', -1), null)").alias("w3"), "n",
    ).withColumn("most", F.max(F.when(F.col("w3").isNotNull(), F.col("n"))).over(extensions)).select(
        "lang", F.col("first").alias("w1"), "w2", "w3", "n",
        F.when(F.col("w3").isNull(), F.coalesce("most", F.lit(0))).otherwise(0).alias("longest"))


def _score(l: str, r: str) -> str:  # noqa: E741
    """floor(1000000 * n * n / (l * r)) in decimals of 38 digits."""
    wide = "cast({} as decimal(19,0))".format
    return f"1000000 * ({wide('n')} * {wide('n')}) div ({wide(l)} * {wide(r)})"


def collocations(docs: DataFrame, text: str, lang: str, least: int = 10, top: int = 2000, subsumed: int = 50) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Candidates are phrases of two or three words with a >= ``least`` occurrences inside pieces (texts are cut at
    ``[.,;:!?\\n-\\r]``, A-Z count as a-z). l and r count the two parts of the cut with the least score, n the language's
    words. A candidate inside a longer one that occurs at least ``subsumed`` percent as often is left out.

    Null texts are empty, a null language is ``und``; repeated rows count each time, ties are ordered by the phrase's bytes;
    other columns, whatever their names, are ignored; an empty table gives an empty one. Long texts are counted in windows.
    """
    phrases = cut_lineage(phrase_counts(docs, text, lang, least))
    words = phrases.where("w1 is not null and w2 is null")
    pairs = phrases.where("w2 is not null and w3 is null")
    triples = phrases.where("w3 is not null")
    total = phrases.where("w1 is null").select("lang", F.col("n").alias("total"))

    def of_word(w: str, out: str) -> DataFrame:
        return words.select("lang", F.col("w1").alias(w), F.col("n").alias(out))

    def of_pair(a: str, b: str, out: str) -> DataFrame:
        return pairs.select("lang", F.col("w1").alias(a), F.col("w2").alias(b), F.col("n").alias(out))

    # The longest entry of a stripe tells of extensions to the right; to the left the suffix is the key.
    left = triples.groupBy("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("n").alias("before"))
    two = (
        pairs.join(left, ["lang", "w1", "w2"], "left")
        .where(100 * F.greatest("longest", F.coalesce("before", F.lit(0))) < subsumed * F.col("n"))
        .join(of_word("w1", "l"), ["lang", "w1"]).join(of_word("w2", "r"), ["lang", "w2"])
        .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "n", "l", "r", F.expr(_score("l", "r")).alias("score"))
    )
    three = (
        triples.join(of_pair("w1", "w2", "l2"), ["lang", "w1", "w2"]).join(of_pair("w2", "w3", "r1"), ["lang", "w2", "w3"])
        .join(of_word("w1", "l1"), ["lang", "w1"]).join(of_word("w3", "r2"), ["lang", "w3"])
        .withColumns({"s1": F.expr(_score("l1", "r1")), "s2": F.expr(_score("l2", "r2"))})
        .select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "n",
                F.expr("if(s1 <= s2, l1, l2)").alias("l"), F.expr("if(s1 <= s2, r1, r2)").alias("r"),
                F.least("s1", "s2").alias("score"))
    )
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("n"), "phrase")
    ranked = two.unionByName(three).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(total), "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", F.col("n").alias("a"), "l", "r", F.col("total").alias("n"), "score")
