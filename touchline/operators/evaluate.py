"""Probability blending, decisions, tuning grids and evaluation, all as aggregates.

Predictions are rows with a ``label`` (0 home, 1 draw, 2 away) and three probability columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODELS = ["gbm", "rf", "logistic", "poisson"]
P = ["p0", "p1", "p2"]


def _share(parts: Sequence[Column]) -> list[Column]:
    total = parts[0] + parts[1] + parts[2]
    return [p / total for p in parts]


def normalize(df: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """Every model's three probabilities clipped to [1e-9, 1] and summing to 1."""
    clipped = {f"{m}_{i}": F.greatest(F.lit(1e-9), F.least(F.lit(1.0), F.col(f"{m}_{i}"))) for m in models for i in range(3)}
    df = df.withColumns(clipped)
    return df.withColumns({f"{m}_{i}": s for m in models for i, s in enumerate(_share([F.col(f"{m}_{k}") for k in range(3)]))})


def blend(df: DataFrame, weights: dict[str, float | Column]) -> DataFrame:
    """Weighted mean of normalized model probabilities as ``p0..p2``, normalized again."""
    as_col = {m: w if isinstance(w, Column) else F.lit(float(w)) for m, w in weights.items()}
    mixed = []
    for i in range(3):
        term = F.lit(0.0)
        for m, w in as_col.items():
            term = term + w * F.col(f"{m}_{i}")
        mixed.append(F.greatest(F.lit(1e-9), F.least(F.lit(1.0), term)))
    df = df.withColumns({f"_m{i}": m for i, m in enumerate(mixed)})
    return df.withColumns(dict(zip(P, _share([F.col(f"_m{i}") for i in range(3)])))).drop("_m0", "_m1", "_m2")


def argmax(parts: Sequence[Column]) -> Column:
    """Index of the largest probability, the lowest index on ties."""
    return F.when((parts[0] >= parts[1]) & (parts[0] >= parts[2]), 0).when(parts[1] >= parts[2], 1).otherwise(2)


def decide(threshold: Column | float | None = None, columns: Sequence[str] = P) -> Column:
    """Most likely class, or draw from the threshold on."""
    best = argmax([F.col(c) for c in columns])
    if threshold is None:
        return best
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(F.col(columns[1]) >= limit, 1).otherwise(best)


def _losses(columns: Sequence[str] = P) -> dict[str, Column]:
    probs = [F.col(c) for c in columns]
    own = F.when(F.col("label") == 0, probs[0]).when(F.col("label") == 1, probs[1]).otherwise(probs[2])
    errors = [p - (F.col("label") == i).cast("double") for i, p in enumerate(probs)]
    squares = [e * e for e in errors]
    # Fixed value: smallest probability the logarithm sees.
    return {"log_loss": F.avg(-F.ln(F.greatest(F.lit(2.220446049250313e-16), own))), "brier": F.avg(squares[0] + squares[1] + squares[2])}


def _confusion() -> list[Column]:
    cell = lambda t, p: F.count_if((F.col("label") == t) & (F.col("prediction") == p)).alias(f"c{t}{p}")
    return [cell(t, p) for t in range(3) for p in range(3)]


def _rates(df: DataFrame) -> DataFrame:
    """Accuracy, per-class precision, recall, F1 and macro F1 of confusion counts ``c<true><predicted>``."""
    c = lambda t, p: F.col(f"c{t}{p}")
    rows = F.col("c00")
    for t, p in [(t, p) for t in range(3) for p in range(3) if (t, p) != (0, 0)]:
        rows = rows + c(t, p)
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    df = df.withColumns({"rows": rows, "accuracy": ratio(c(0, 0) + c(1, 1) + c(2, 2), rows)})
    for i, name in enumerate(("home", "draw", "away")):
        predicted, actual = c(0, i) + c(1, i) + c(2, i), c(i, 0) + c(i, 1) + c(i, 2)
        df = df.withColumns({
            f"{name}_precision": ratio(c(i, i), predicted), f"{name}_recall": ratio(c(i, i), actual),
            f"{name}_f1": ratio(2 * c(i, i), predicted + actual)})
    return df.withColumn("macro_f1", (F.col("home_f1") + F.col("draw_f1") + F.col("away_f1")) / 3)


def metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, log loss, Brier score, macro F1, per-class rates and the confusion matrix."""
    return _rates(df.groupBy(*by).agg(*_confusion(), *[v.alias(k) for k, v in _losses().items()]))


def tournament_bucket(col: str = "tournament") -> Column:
    text = F.lower(F.coalesce(col, F.lit("")))
    return F.when(text.contains("world cup"), "world_cup").when(text.contains("friendly"), "friendly").otherwise("other")


def by_segment(df: DataFrame) -> DataFrame:
    out = _rates(df.withColumn("bucket", tournament_bucket()).groupBy("bucket").agg(*_confusion()))
    return out.select("bucket", "rows", "accuracy", "draw_recall")


def odds_baseline(odds: Sequence[str]) -> Column:
    """Class of the lowest closing price (home, draw, away on ties); missing prices do not count."""
    low = F.least(*odds)
    return F.when(F.col(odds[0]) == low, 0).when(F.col(odds[1]) == low, 1).when(F.col(odds[2]) == low, 2)


# Right-closed confidence bins.
BINS = [0.0, 0.45, 0.55, 0.65, 0.75, 0.85, 1.0]


def confidence_buckets(df: DataFrame) -> DataFrame:
    """Hit rate and mean confidence per confidence bin; empty bins do not appear."""
    confidence = F.greatest(*P)
    bucket = F
    for low, high in zip(BINS, BINS[1:]):
        bucket = bucket.when(confidence <= high, f"({low}, {high}]")
    hit = (F.col("label") == F.col("prediction")).cast("double")
    return df.groupBy(bucket.alias("bucket")).agg(
        F.count("*").alias("matches"), F.avg(hit).alias("hit_rate"), F.avg(confidence).alias("avg_confidence"))


def strategy_audit(df: DataFrame, baseline: str) -> DataFrame:
    """One record: model metrics beside the baseline's accuracy."""
    out = _rates(df.agg(*_confusion(), F.avg((F.col(baseline) == F.col("label")).cast("double")).alias("baseline_accuracy"),
                        *[v.alias(k) for k, v in _losses().items()]))
    return out.withColumn("beats_baseline", F.col("accuracy") > F.col("baseline_accuracy")).select(
        "rows", "accuracy", "baseline_accuracy", "log_loss", "brier", "draw_recall", "draw_precision", "beats_baseline")


def overfit_verdict(train: Column, test: Column) -> Column:
    gap = train - test
    return F.when(gap >= 0.15, "clear_overfitting").when(gap >= 0.08, "some_overfitting").otherwise("no_clear_overfitting")


# A blend's shares are whole tenths, at most six for a model, at least two for boosting, at most four for
# Poisson; one blend in twentieths is tried too.
EXTRA_BLEND = (9, 4, 4, 3)


def blend_candidates(spark: SparkSession) -> DataFrame:
    """One row per candidate blend: its number and the four models' shares, which sum to one."""
    tenths = spark.range(2, 7).toDF("g").join(spark.range(7).toDF("f"), F.expr("g + f <= 10")).join(
        spark.range(7).toDF("l"), F.expr("g + f + l between 6 and 10"))
    # Sorted by shares, of which the first three tell the blends apart.
    number = (F.col("g") * 49 + F.col("f") * 7 + F.col("l")).cast("int")
    shares = [F.col("g") / 10, F.col("f") / 10, F.col("l") / 10, (10 - F.col("g") - F.col("f") - F.col("l")) / 10]
    names = [f"w_{m}" for m in MODELS]
    extra = spark.range(1).select(F.lit(1000).alias("candidate"), *[F.lit(v / 20).alias(n) for v, n in zip(EXTRA_BLEND, names, strict=True)])
    return tenths.select(number.alias("candidate"), *[v.alias(n) for v, n in zip(shares, names, strict=True)]).unionByName(extra)


def weight_scores(df: DataFrame) -> DataFrame:
    """Log loss, accuracy and Brier score of every candidate blend.

    The candidates, about a hundred rows whatever the input, are gathered into one array that is exploded beside each row;
    the exploded rows are summed map-side at once, and nothing but one line per candidate is shuffled.
    """
    names = ["candidate", *[f"w_{m}" for m in MODELS]]
    grid = blend_candidates(df.sparkSession).agg(F.collect_list(F.struct(*names)).alias("grid")).scalar()
    rows = normalize(df).select("label", *[f"{m}_{i}" for m in MODELS for i in range(3)], F.inline(grid))
    rows = blend(rows, {m: F.col(f"w_{m}") for m in MODELS}).withColumn("prediction", decide())
    hit = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    return rows.groupBy(*names).agg(hit.alias("accuracy"), *[v.alias(k) for k, v in _losses().items()])


# The draw thresholds tried, 0.20 to 0.38, and the accuracy a threshold may cost.
THRESHOLDS = [round(0.20 + 0.01 * i, 2) for i in range(19)]
ACCURACY_GUARD = 0.005


def threshold_scores(df: DataFrame) -> DataFrame:
    """Metrics of plain argmax (null threshold) and of every draw threshold."""
    grid = F.array(F.lit(None).cast("double"), *[F.lit(t) for t in THRESHOLDS])
    rows = df.select("label", *P, F.explode(grid).alias("draw_threshold"))
    rows = rows.withColumn("prediction", F.when(F.col("draw_threshold").isNull(), decide()).otherwise(decide(F.col("draw_threshold"))))
    out = _rates(rows.groupBy("draw_threshold").agg(*_confusion()))
    return out.select("draw_threshold", "accuracy", "macro_f1", "draw_recall", (F.col("c01") + F.col("c11") + F.col("c21")).alias("draw_predictions"))


def best_threshold(scores: DataFrame) -> DataFrame:
    """Best macro F1, draw recall, accuracy, then the lowest threshold, among those near argmax accuracy."""
    base = scores.where("draw_threshold is null").select((F.col("accuracy") - ACCURACY_GUARD).alias("a"))
    viable = scores.where(F.col("accuracy") >= base.scalar())
    low = F.when(F.col("draw_threshold").isNull(), F.lit(-999.0)).otherwise(-F.col("draw_threshold"))
    return viable.orderBy(F.desc(F.round("macro_f1", 12)), F.desc(F.round("draw_recall", 12)), F.desc("accuracy"), F.desc(low)).limit(1)
