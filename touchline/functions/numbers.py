"""Numeric column helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(col: Column | str) -> Column:
    """Text or number to double; blank, malformed and NaN become null."""
    col = F.col(col) if isinstance(col, str) else col
    text = F.trim(col.cast("string"))
    value = text.try_cast("double")
    # The JVM reads a type suffix ("7d") as part of a number; it is not one.
    return F.when(~F.isnan(value) & ~text.rlike("[0-9.][dDfF]$"), value)


def clip(col: Column, low: float, high: float) -> Column:
    """Bound ``col``; null stays null (``least``/``greatest`` alone would skip it)."""
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(low)), F.lit(high)))


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den``, null for a zero or missing denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def half_even(col: Column) -> Column:
    """Round to the nearest integer, halves to even."""
    return F.bround(col, 0).cast("int")


def clamp_score(col: Column | str, low: int = -3, high: int = 3) -> Column:
    """Rounded score inside ``[low, high]``; anything unreadable is 0."""
    # Clipped one step too wide first, so that no value is out of an integer's range when rounded.
    value = half_even(clip(to_number(col), low - 1.0, high + 1.0))
    return F.when(value.isNull(), 0).when(value < low, low).when(value > high, high).otherwise(value)


def mean_available(df_columns: list[str], wanted: list[str]) -> Column:
    """Row mean over the ``wanted`` columns that exist, nulls skipped, 0 when nothing is left."""
    present = [to_number(c) for c in wanted if c in df_columns]
    if not present:
        return F.lit(0.0)
    values = F.filter(F.array(*present), lambda x: x.isNotNull())
    return F.coalesce(
        F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values)), F.lit(0.0)
    )
