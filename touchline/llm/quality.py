"""Quality of texts without labels: heuristic labellers, a label model, and a scorer trained on its posteriors.

Each labeller votes good, bad, or not at all. Expectation-maximisation over the counts of vote patterns of the whole corpus
estimates how often each labeller is right; the posterior of a document's pattern is its label. A logistic scorer over
hashed byte n-grams learns these labels and judges every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.arrow_text import blocks, column, words
from touchline.llm.langid import (
    BITS, Regression, counted, document_frequencies, gram_counts, inverse_frequencies, softmax, weighed)

#: Rows that the scorer is trained on at most, about.
SAMPLE = 2400
NEVER = -1.0
#: (name, statistic, bad from here on, good up to here): a labeller votes on one statistic and abstains in between.
LABELLERS = (
    ("symbols", "symbol_share", 0.06, 0.02),
    ("shouting", "capital_share", 0.5, NEVER),
    ("exclaiming", "exclaim_rate", 0.3, NEVER),
    ("signed words", "sign_end_share", 0.6, 0.35),
    ("wordless tokens", "bare_share", 0.3, NEVER),
    ("digits", "digit_share", 0.3, NEVER),
    ("stuttering", "stutter_share", 0.2, NEVER),
    ("repeated lines", "line_repeat_share", 0.5, NEVER),
    ("long words", "word_bytes", 25.0, NEVER),
)
GOOD, BAD, SILENT = 0, 1, 2
#: Some shares say little about fewer words; those labellers are silent then.
FEW_WORDS, BY_WORDS = 10, {
    "capital_share", "digit_share", "exclaim_rate", "sign_end_share", "bare_share", "stutter_share", "word_bytes"}


def _kinds() -> np.ndarray:
    """Of each byte: 0 lower-case letter or part of another character, 1 capital, 2 digit, 3 space, 4 common sign, 5 symbol."""
    kind = np.full(256, 5, np.int8)
    kind[97:123] = kind[128:] = 0
    kind[65:91], kind[48:58] = 1, 2
    kind[[32, *range(9, 14)]] = 3
    kind[[ord(c) for c in ".,;:!?'\"()-"]] = 4
    return kind


def byte_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and counts of a text's byte n-grams, case and signs included."""
    codes = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    return gram_counts(codes) if len(codes) else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The labellers' statistics of every text of a block."""
    n = len(offsets) - 1
    kind = _kinds()[data]
    sums = np.zeros((len(data) + 1, 6), np.int64)
    for k in range(6):
        np.cumsum(kind == k, out=sums[1:, k])
    of = sums[offsets[1:]] - sums[offsets[:-1]]
    loud = np.concatenate([[0], np.cumsum(data == 33)])
    hashes, first, last, at = words(data, offsets)
    count = np.diff(at)
    ends = np.concatenate([[0], np.cumsum(kind[last - 1] >= 4)]) if len(first) else np.zeros(1, np.int64)
    letters = sums[:, 0] + sums[:, 1]
    bare = np.concatenate([[0], np.cumsum(letters[last] == letters[first])]) if len(first) else np.zeros(1, np.int64)
    sizes = np.concatenate([[0], np.cumsum(last - first)])
    some, body = np.maximum(count, 1), np.maximum(of.sum(axis=1) - of[:, 3], 1)
    within = lambda total: (total[at[1:]] - total[at[:-1]]) / some
    same = np.concatenate([[False], hashes[1:] == hashes[:-1]]) if len(first) else np.zeros(0, bool)
    same[at[:-1][count > 0]] = False
    stutter = np.concatenate([[0], np.cumsum(same)])
    again = np.zeros(n)
    for i in range(n):
        lines = data[offsets[i]:offsets[i + 1]].tobytes().split(b"\n")
        again[i] = 1 - len(set(lines)) / len(lines)
    return {
        "words": count, "symbol_share": of[:, 5] / body,
        "capital_share": of[:, 1] / np.maximum(of[:, 0] + of[:, 1], 1),
        "exclaim_rate": (loud[offsets[1:]] - loud[offsets[:-1]]) / some, "sign_end_share": within(ends),
        "bare_share": within(bare), "digit_share": of[:, 2] / body, "stutter_share": within(stutter),
        "line_repeat_share": again, "word_bytes": within(sizes),
    }


def votes(docs: DataFrame, id: str, text: str, labellers=LABELLERS) -> DataFrame:
    """id, pattern (votes as digits to base 3, the first labeller's lowest) of every row; texts without words get none but
    bad votes of no labeller: all are silent."""
    key = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pattern = []
            for _, data, offsets in blocks(column(batch, "_text")):
                seen = statistics(data, offsets)
                code = np.zeros(len(offsets) - 1, np.int64)
                for j, (_, name, bad, good) in enumerate(labellers):
                    vote = np.where(seen[name] >= bad, BAD, np.where(seen[name] <= good, GOOD, SILENT))
                    code += 3**j * np.where(seen["words"] >= (FEW_WORDS if name in BY_WORDS else 1), vote, SILENT)
                pattern.append(code)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(pattern) if pattern else [], pa.int64())], [id, "pattern"])

    return docs.select(docs[id].alias("_id"), docs[text].alias("_text")).mapInArrow(run, f"`{id}` {key}, pattern bigint")


@dataclass
class LabelModel:
    """prior[c]: share of a class; table[j, c, v]: chance that labeller j votes v (good or bad) on a document of class c if
    it votes. Silence tells nothing."""

    prior: np.ndarray
    table: np.ndarray

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """Chance of being good, per pattern."""
        chance = np.log(self.prior)[None, :] + np.zeros((len(pattern), 2))
        for j in range(len(self.table)):
            tells = np.concatenate([np.log(self.table[j]), np.zeros((2, 1))], axis=1)
            chance += tells[:, pattern // 3**j % 3].T
        return softmax(chance)[:, GOOD]

    def accuracies(self) -> np.ndarray:
        """Chance that each labeller's vote is right, where it votes."""
        return self.prior[GOOD] * self.table[:, GOOD, GOOD] + self.prior[BAD] * self.table[:, BAD, BAD]


#: What is taken for granted of a labeller's votes before any are seen, by class (good, bad) and vote (good, bad), and how
#: many documents that weighs, as a share of all: bad votes on good documents are rare, bad ones are often missed.
BELIEF = np.array([[0.9995, 0.0005], [0.7, 0.3]])
BELIEF_SHARE = np.array([1.0, 0.05])


def label_model(pattern: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over counted vote patterns.

    It begins with documents that have any bad vote as probably bad; from there it learns how much each labeller's votes tell.
    """
    digit = pattern[:, None] // 3 ** np.arange(labellers)[None, :] % 3
    p = np.where((digit == BAD).any(axis=1), 0.05, 0.95)
    believed = BELIEF * (BELIEF_SHARE * max(counts.sum(), 1))[:, None]
    model = LabelModel(np.array([0.5, 0.5]), np.repeat(BELIEF[None], labellers, axis=0))
    for _ in range(rounds):
        weight = np.stack([p * counts, (1 - p) * counts])
        prior = (weight.sum(axis=1) + 1) / (weight.sum() + 2)
        table = np.stack([[[weight[c][digit[:, j] == v].sum() for v in (GOOD, BAD)] for c in (GOOD, BAD)]
                          for j in range(labellers)]) + believed
        model = LabelModel(prior, table / table.sum(axis=2, keepdims=True))
        new = model.posterior(pattern)
        if np.abs(new - p).max(initial=0) < 1e-6:
            break
        p = new
    return model


def quality(docs: DataFrame, id: str, text: str, threshold: float = 0.3, sample: int = SAMPLE, epochs: int = 3) -> DataFrame:
    """Per row: id, pattern, posterior (label model), score (scorer, 0 to 1), kept (score >= ``threshold``).

    Null texts are empty; texts without words have score 0. Rows may repeat, ids may be null, other columns are ignored;
    an empty table gives an empty one. The driver gets the counts of patterns (at most 3 to the number of labellers), one
    row per feature, and about ``sample`` rows, half of them good by the label model and half bad, as far as there are so
    many; all counts cover all rows.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id].alias("_id"), F.coalesce(docs[text], F.lit("")).alias("_body"))
    seen = votes(rows.select(F.struct("_id", "_body").alias("_row"), "_body"), "_row", "_body")
    counts = np.array(seen.groupBy("pattern").count().collect(), np.int64).reshape(-1, 2)
    model = label_model(counts[:, 0], counts[:, 1], len(LABELLERS))
    good = model.posterior(counts[:, 0])
    frequencies = document_frequencies(rows, "_body", byte_counts)
    idf = inverse_frequencies(*frequencies)
    # Chances of being drawn, so that either side gives half of the sample.
    total = [(counts[:, 1] * (good >= 0.5)).sum(), (counts[:, 1] * (good < 0.5)).sum()]
    known = {int(k): (float(g), min(1.0, sample / 2 / max(total[int(g < 0.5)], 1)))
             for k, g in zip(counts[:, 0], good, strict=True)}
    table = F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, v[0])]) if known else None
    chance = F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, v[1])]) if known else None
    regression = Regression(1 << BITS, 2)
    if known:
        drawn = seen.where(F.pmod(F.xxhash64("_row"), F.lit(1 << 30)) < F.element_at(chance, F.col("pattern")) * (1 << 30))
        picked = counted(drawn.select(F.element_at(table, F.col("pattern")).alias("_p"), F.xxhash64("_row").alias("_at"),
                                      F.col("_row._body").alias("_body")), "_body", ["_p", "_at"], byte_counts).collect()
        data = sorted((r[1], r[0], bytes(r[2]), bytes(r[3])) for r in picked if r[2])
        for _ in range(epochs):
            for _, p, at, n in data:
                at = np.frombuffer(at, np.uint16).astype(np.int64)
                regression.learn(at, weighed(at, np.frombuffer(n, np.uint32), idf), np.array([p, 1 - p]))
    weights = regression.weights()
    # The sample holds as many bad rows as good ones: the constant takes that back.
    weights[-1, GOOD] += np.log(min(1.0, sample / 2 / max(total[1], 1)) / min(1.0, sample / 2 / max(total[0], 1)))
    shared = spark.sparkContext.broadcast((weights, idf, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, idf, model = shared.value
        for batch in batches:
            texts = column(batch, "_text").to_pylist()
            score = []
            for t in texts:
                at, n = byte_counts(t)
                # Without a word there is nothing to judge; words are what is not white space.
                score.append(float(softmax(weighed(at, n, idf) @ weights[at] + weights[-1])[GOOD])
                             if t.strip(" \t\n\x0b\x0c\r") else 0.0)
            pattern = batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pattern, pa.array(model.posterior(pattern.to_numpy()), pa.float64()),
                 pa.array(score, pa.float64()), pa.array([s >= threshold for s in score], pa.bool_())],
                [id, "pattern", "posterior", "score", "kept"])

    key = docs.schema[id].dataType.simpleString()
    return seen.select(F.col("_row._id").alias("_id"), "pattern", F.col("_row._body").alias("_text")).mapInArrow(
        run, f"`{id}` {key}, pattern bigint, posterior double, score double, kept boolean")
