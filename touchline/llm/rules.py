"""Quality rules: statistics of whole texts, and a decision list learned from labelled ones.

Sequential covering: a rule for bad documents is grown condition by condition (threshold on one statistic) on two thirds of
the labelled rows by information gain, pruned on the other third, and kept while it is right there; the rows it covers are
taken away and the next rule is sought. The list becomes one ordered Spark conditional expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.arrow_text import blocks, column
from touchline.session import cut_lineage

#: Labelled rows that the list is learned from at most, half of them of either class where there are as many.
LABELLED = 20_000
#: A rule stays if it is right about this share of the rows held back from growing it, by weight.
LEAST_RIGHT = 0.95
SYMBOLS = "#*$%&|<>"
#: Counts of a text, as ``statistics`` gives them.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclaims", "n_digits")
#: What conditions speak of: a name and an expression over the counts of a text with words.
FEATURES = {
    "words": "double(n_words)",
    "word length": "word_chars / n_words",
    "symbols per word": "n_symbols / n_words",
    "share of repeated lines": "n_dup_lines / n_lines",
    "share of repeated words": "n_repeat_words / n_words",
    "capitals per character": "n_capitals / word_chars",
    "exclamations per word": "n_exclaims / n_words",
    "digits per character": "n_digits / word_chars",
}
#: The base rule, over counts.
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def _parts(data: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(texts, first byte, document) of the maximal runs of bytes outside ``between``; texts' ends also part them."""
    inside = ~between
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    last = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    at = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int64)
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(data[inside])])
    return runs, first, np.searchsorted(offsets, first, side="right") - 1


def _numbers(values: pa.Array) -> np.ndarray:
    return values.dictionary_encode().indices.to_numpy().astype(np.int64)


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of distinct (left, right)."""
    return np.unique(left << 32 | right, return_inverse=True)[1].astype(np.int64) if len(left) else left


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """``COUNTS`` of every text of a block; words and lines are compared as they are, not by hashes."""
    n = len(offsets) - 1
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    symbol, digit, loud, capital = np.zeros((4, 256), bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    digit[48:58], capital[65:91], loud[33] = True, True, True

    def per_text(marks: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    def per_part(of: np.ndarray) -> np.ndarray:
        return np.bincount(of, minlength=n).astype(np.int64)

    apart = space[data]
    words, _, of = _parts(data, offsets, apart)
    ids = _numbers(words)
    inside = np.flatnonzero(of[2:] == of[:-2])
    windows = _pair(_pair(_pair(ids[inside], ids[inside + 1]), ids[inside + 2]), of[inside])
    often = inside[np.bincount(windows)[windows] > 1] if len(windows) else inside
    repeated = np.zeros(len(ids), bool)
    for step in range(3):
        repeated[often + step] = True
    lines, begin, line_of = _parts(data, offsets, data == 10)
    # A line has a word if something other than white space comes before its end.
    solid = np.concatenate([[0], np.cumsum(~apart, dtype=np.int64)])
    size = np.diff(np.frombuffer(lines.buffers()[1], np.int64)[:len(lines) + 1])
    full = solid[begin + size] > solid[begin]
    same = _pair(_numbers(lines)[full], line_of[full])
    distinct = np.unique(same, return_index=True)[1]
    n_lines = per_part(line_of[full])
    return {
        "n_words": per_part(of), "word_chars": per_text(~apart & ((data & 0xC0) != 0x80)), "n_symbols": per_text(symbol[data]),
        "n_dup_lines": n_lines - per_part(line_of[full][distinct]), "n_repeat_words": per_part(of[repeated]), "n_lines": n_lines,
        "n_capitals": per_text(capital[data]), "n_exclaims": per_text(loud[data]), "n_digits": per_text(digit[data]),
    }


def counted(docs: DataFrame, id: str, text: str) -> DataFrame:
    """id and ``COUNTS`` of every row."""
    key = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [statistics(data, offsets) for _, data, offsets in blocks(column(batch, "_text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.concatenate([s[c] for s in seen]) if seen else [], pa.int64()) for c in COUNTS)],
                [id, *COUNTS])

    return docs.select(docs[id].alias("_id"), docs[text].alias("_text")).mapInArrow(
        run, ", ".join([f"`{id}` {key}", *(f"{c} bigint" for c in COUNTS)]))


@dataclass(frozen=True)
class Condition:
    """``feature`` at least (or below) a threshold."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value, bound = F.expr(FEATURES[self.feature]), F.lit(self.threshold)
        return value >= bound if self.above else value < bound

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.feature] >= self.threshold if self.above else values[self.feature] < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules for bad documents, the first that holds decides; none: good."""

    rules: tuple[tuple[Condition, ...], ...] = field(default=())

    def column(self) -> Column:
        """Number of the first rule that holds (from 1), 0 if none does, as one ordered conditional expression."""
        choice = None
        for k, rule in enumerate(self.rules, 1):
            holds = reduce(Column.__and__, [c.column() for c in rule])
            choice = F.when(holds, k) if choice is None else choice.when(holds, k)
        return F.lit(0) if choice is None else choice.otherwise(0)

    def __str__(self) -> str:
        lines = [f"{'if' if k == 0 else 'else if'} {' and '.join(map(str, rule))}: bad" for k, rule in enumerate(self.rules)]
        return "\n".join([*lines, "else good" if lines else "good"])


def _covered(rule, values: dict[str, np.ndarray]) -> np.ndarray:
    return reduce(np.logical_and, [c.holds(values) for c in rule]) if rule else np.ones(len(next(iter(values.values()))), bool)


def _best_condition(values: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray) -> tuple[float, Condition | None]:
    """The condition of most information gain: bad weight covered times the bits by which their share rises."""
    total_p, total = (weight * bad).sum(), weight.sum()
    best: tuple[float, Condition | None] = (1e-9, None)
    for name, v in values.items():
        order = np.argsort(v, kind="stable")
        cut = np.flatnonzero(np.diff(v[order]) > 0)
        if not len(cut):
            continue
        threshold = (v[order][cut] + v[order][cut + 1]) / 2
        below_p, below = np.cumsum((weight * bad)[order])[cut], np.cumsum(weight[order])[cut]
        for above, p, all_ in ((False, below_p, below), (True, total_p - below_p, total - below)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / all_) - np.log2(total_p / total)), -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), Condition(name, above, float(threshold[k])))
    return best


def grow(values: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray) -> tuple[Condition, ...]:
    """Adds the best condition until the rule covers bad rows only, or nothing gains."""
    rule: tuple[Condition, ...] = ()
    inside = np.ones(len(bad), bool)
    while bad[inside].any() and not bad[inside].all():
        _, found = _best_condition({k: v[inside] for k, v in values.items()}, bad[inside], weight[inside])
        if found is None:
            break
        rule = (*rule, found)
        inside &= found.holds(values)
    return rule


def prune(rule, values: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray):
    """Cuts the rule's end off where it does better so on rows that it was not grown on: most (bad - good) / covered."""
    def worth(k: int) -> float:
        inside = _covered(rule[:k], values)
        p, n = (weight * bad)[inside].sum(), (weight * ~bad)[inside].sum()
        return (p - n) / (p + n) if p + n else -1.0

    return rule[:max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def learn(values: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray | None = None, least_right: float = LEAST_RIGHT) -> DecisionList:
    """Sequential covering of the bad rows. Every third row is held back for pruning; order the rows at random before."""
    weight = np.ones(len(bad)) if weight is None else weight
    held, rules = np.arange(len(bad)) % 3 == 2, []
    left = np.ones(len(bad), bool)
    while bad[left & ~held].any():
        part = lambda rows: ({k: v[rows] for k, v in values.items()}, bad[rows], weight[rows])
        rule = grow(*part(left & ~held))
        rule = prune(rule, *part(left & held))
        if not rule:
            break
        inside = _covered(rule, values) & left
        right = (weight * bad)[inside & held].sum()
        if right == 0 or right < least_right * weight[inside & held].sum():
            break
        rules.append(rule)
        left &= ~inside
    return DecisionList(tuple(rules))


def fit(stats: DataFrame, labels: DataFrame, id: str, label_id: str, quality: str, labelled: int = LABELLED) -> DecisionList:
    """The list learned from texts that the base rule passes and that have a label (0 bad, 1 good; several: their mean).

    At most ``labelled`` rows reach the driver, chosen by a hash, half of them of either class where there are as many;
    they weigh as much as their class has in all. No labels, or labels of one class, give the empty list.
    """
    marks = labels.select(labels[label_id].alias("_label_id"), labels[quality].alias("_q")).groupBy("_label_id").agg(F.avg("_q").alias("_q"))
    known = cut_lineage(
        stats.where(f"not ({BASE_FAILED})").join(marks.where("_q is not null"), stats[id] == F.col("_label_id"))
        .select((F.col("_q") < 0.5).alias("bad"), F.xxhash64(id, *COUNTS).alias("at"),
                *[F.expr(e).alias(f"f{k}") for k, e in enumerate(FEATURES.values())]))
    sizes = {r["bad"]: r["count"] for r in known.groupBy("bad").count().collect()}
    if len(sizes) < 2:
        return DecisionList()
    rows, weight = [], []
    for bad, size in sorted(sizes.items()):
        share = max(labelled // 2, labelled - sizes[not bad])
        found = known.where(F.col("bad") == bad).orderBy("at", *[f"f{k}" for k in range(len(FEATURES))]).limit(share).collect()
        rows += found
        weight += [size / len(found)] * len(found)
    order = sorted(range(len(rows)), key=lambda k: tuple(rows[k])[1:])
    values = {name: np.array([rows[k][f"f{j}"] for k in order], float) for j, name in enumerate(FEATURES)}
    return learn(values, np.array([rows[k]["bad"] for k in order], bool), np.array(weight)[order])


def judged(docs: DataFrame, labels: DataFrame, id: str, text: str, label_id: str, quality: str, labelled: int = LABELLED) -> DataFrame:
    """Per row: id, counts, base_failed, rule (first rule of the learned list that holds, 0 for none), kept.

    kept is false if the base rule fails, else by the list. Null texts have no words and fail; rows may repeat, ids may be
    null (they have no label), other columns are ignored; an empty table gives an empty one. Texts are counted whole, once.
    """
    stats = cut_lineage(counted(docs, id, text))
    rules = fit(stats, labels, id, label_id, quality, labelled)
    return stats.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn(
        "rule", F.when(F.col("base_failed"), 0).otherwise(rules.column())).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0))
