"""Language of texts by sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all training rows. The regression is trained by follow-the-regularised-leader with
elastic-net penalties on a sample of bounded size, and a temperature is fitted on a part of the sample held back for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.arrow_text import column

#: N-grams of 1 to GRAMS characters, hashed to 2**BITS features.
GRAMS, BITS = 3, 16
#: Training rows of the regression at most, about, over all languages; languages share them evenly.
SAMPLE = 2400
UNKNOWN = "und"
#: Rows that a task sends at once: the JVM holds their texts outside its heap.
SENT = 1 << 10
#: Characters turned into n-grams at once; a longer text is counted part by part, n-grams across the cuts included.
PART = 1 << 20


@lru_cache
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else 32: words are told apart, signs are not."""
    return np.fromiter((i if chr(i).isalpha() else 32 for i in range(0x110000)), np.uint32, 0x110000)


def character_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features (sorted) and counts of a text's n-grams of lower-case letters; empty if there is no letter."""
    codes = _letters()[np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)]
    if not (codes != 32).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Runs of other characters count as one space, also before and after the text.
    codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]])
    codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]
    return gram_counts(codes)


def gram_counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features (sorted) and counts of the n-grams of a sequence of 32-bit codes."""
    if len(codes) <= PART:
        return np.unique(_features(codes, 0), return_counts=True)
    total = np.zeros(1 << BITS, np.int64)
    for at in range(0, len(codes), PART):
        low = max(0, at - GRAMS + 1)
        total += np.bincount(_features(codes[low:at + PART], at - low), minlength=1 << BITS)
    found = np.flatnonzero(total)
    return found, total[found]


def _features(codes: np.ndarray, old: int) -> np.ndarray:
    """Features of all n-grams that end at position ``old`` or later."""
    out, value = [], np.zeros(len(codes) + 1, np.uint32)
    for n in range(1, GRAMS + 1):
        if len(codes) < n:
            break
        value = value[:-1] * np.uint32(0x01000193) + codes[n - 1:] + np.uint32(n)
        mixed = (value ^ (value >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        mixed = (mixed ^ (mixed >> np.uint32(12))) * np.uint32(0x297A2D39)
        out.append((mixed >> np.uint32(32 - BITS))[max(0, old - n + 1):])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def weighed(features: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of unit length; a feature's own share grows with the logarithm of its count."""
    x = (1 + np.log(counts)) * idf[features]
    return x / max(np.sqrt(x @ x), 1e-12)


class Regression:
    """Multinomial logistic regression, trained by follow-the-regularised-leader (proximal) with elastic net.

    ``z`` and ``n`` hold summed gradients and squared gradients; a weight is zero while \\|z\\| <= ``l1``.
    """

    def __init__(self, features: int, classes: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.z, self.n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def _weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return -np.sign(z) * np.maximum(0, np.abs(z) - self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, target: np.ndarray) -> None:
        """One row: features, their weights, and the classes' probabilities. The last feature is the constant."""
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self._weights(at)
        g = x[:, None] * (softmax(x @ w) - target)[None, :]
        more = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = more

    def weights(self) -> np.ndarray:
        return self._weights(slice(None)).astype(np.float32)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, answers: np.ndarray) -> float:
    """The divisor of ``logits`` with the least log loss, by golden sections between 1/20 and 20."""
    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))[np.arange(len(answers)), answers]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    low, high, cut = -np.log(20), np.log(20), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - cut * (high - low), low + cut * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str) -> tuple[str, float]:
        """A language and its calibrated probability; ``und`` and 0 for a text without letters or a model without languages."""
        at, counts = character_counts(text)
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        logits = weighed(at, counts, self.idf) @ self.weights[at] + self.weights[-1]
        p = softmax(logits.astype(np.float64) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def counted(docs: DataFrame, text: str, keep: list[str], count: Callable = character_counts) -> DataFrame:
    """``keep`` columns, at (16-bit features) and n (32-bit counts) of every row's text, as binary columns."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [count(t.as_py()) for t in column(batch, "_text")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([a.astype(np.uint16).tobytes() for a, _ in rows], pa.binary()),
                 pa.array([c.astype(np.uint32).tobytes() for _, c in rows], pa.binary())], [*keep, "at", "n"])

    return docs.select(*keep, docs[text].alias("_text")).mapInArrow(run, f"{columns}, at binary, n binary")


def document_frequencies(docs: DataFrame, text: str, count: Callable = character_counts) -> tuple[np.ndarray, int]:
    """How many texts have each feature, and how many have any. Every task sums its own texts first; the driver gets one
    row per feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BITS) + 1, np.int64)
        for batch in batches:
            for t in column(batch, "_text"):
                at, _ = count(t.as_py())
                total[at] += 1
                total[-1] += len(at) > 0
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["at", "n"])

    sums = docs.select(docs[text].alias("_text")).mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n"))
    total = np.zeros((1 << BITS) + 1, np.int64)
    for at, n in sums.collect():
        total[at] = n
    return total[:-1], int(total[-1])


def inverse_frequencies(frequencies: np.ndarray, n: int) -> np.ndarray:
    return np.log((1 + n) / (1 + frequencies)) + 1


def fit(docs: DataFrame, id: str, text: str, language: str, sample: int = SAMPLE, epochs: int = 3) -> LanguageModel:
    """A model of the rows of ``docs`` that have a language. ``docs`` should hold training rows only.

    Document frequencies cover all of them; the regression sees about ``sample`` rows at most, chosen by a hash of id and
    text, as many of each language; every fifth is kept for the temperature.
    """
    known = docs.where(docs[language].isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(language).count().orderBy(language).limit(sample).collect()}
    if not sizes:
        return LanguageModel([], np.ones(1 << BITS), np.zeros(((1 << BITS) + 1, 0), np.float32), 1.0)
    idf = inverse_frequencies(*document_frequencies(known, text))
    languages = sorted(sizes)
    share = sample / len(languages)
    chance = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, share / sizes[k]))])
    # try_element_at: languages beyond the sample's size, each rarer than one row in ``sample``, get none.
    drawn = F.pmod(F.xxhash64(id, text), F.lit(1 << 30)) < F.try_element_at(chance, F.col(language)) * (1 << 30)
    part = F.pmod(F.xxhash64(text, id, F.lit(1)), F.lit(1 << 30)).alias("_part")
    rows = counted(known.where(drawn).select(F.col(language).alias("_lang"), part, F.col(text).alias("_body")), "_body",
                   ["_lang", "_part"]).collect()
    rows = sorted(((r[1], languages.index(r[0]), bytes(r[2]), bytes(r[3])) for r in rows if r[2]))
    data = [(k, np.frombuffer(at, np.uint16).astype(np.int64), np.frombuffer(n, np.uint32)) for _, k, at, n in rows]
    data = [(k, at, weighed(at, n, idf)) for k, at, n in data]
    learned, held = [d for i, d in enumerate(data) if i % 5], data[::5]
    model = Regression(1 << BITS, len(languages))
    for _ in range(epochs):
        for k, at, x in learned:
            model.learn(at, x, np.eye(len(languages))[k])
    weights = model.weights()
    heat = 1.0
    if held and len(languages) > 1:
        logits = np.stack([x @ weights[at] + weights[-1] for _, at, x in held]).astype(np.float64)
        heat = temperature(logits, np.array([k for k, _, _ in held]))
    return LanguageModel(languages, idf, weights, heat)


def predict(docs: DataFrame, model: LanguageModel, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with lang_pred and score of every row's whole text; nothing is shuffled. Null texts are ``und``.

    If ``keep`` holds the text itself, it goes through Arrow once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    at = keep.index(text) if text in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(n, SENT) for b in batches for n in range(0, b.num_rows, SENT)):
            told = [shared.value.predict(t.as_py() or "") for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array([a for a, _ in told], pa.string()),
                 pa.array([s for _, s in told], pa.float64())], [*keep, "lang_pred", "score"])

    sent = docs.select(*keep) if text in keep else docs.select(*keep, docs[text].alias("_text"))
    return sent.mapInArrow(run, f"{columns}, lang_pred string, score double")


def held_out(id: str, folds: int = 3, fold: int = 1):
    """Whether crc32 of the id as text falls into the fold that is not learned from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def identify(docs: DataFrame, id: str, text: str, language: str, sample: int = SAMPLE) -> DataFrame:
    """Per row: id, held_out, lang_pred, score (0 to 1). Only rows that are not held out are learned from.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if no row has a language. Rows may
    repeat; ids may be null; other columns are ignored; an empty table gives an empty one.
    """
    marked = docs.select(docs[id].alias("_id"), docs[text].alias("_body"), docs[language].alias("_lang"),
                         held_out(id).alias("held_out"))
    model = fit(marked.where("not held_out"), "_id", "_body", "_lang", sample)
    return predict(marked, model, "_body", ["_id", "held_out"]).withColumnRenamed("_id", id)
