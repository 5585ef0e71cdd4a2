"""Small helpers of the registered queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r6(col: Column | str, name: str | None = None) -> Column:
    """Rounded double for result comparison."""
    label = name or (col if isinstance(col, str) else None)
    out = F.round((F.col(col) if isinstance(col, str) else col).cast("double"), 6)
    return out.alias(label) if label else out


def show(df: DataFrame, keys: Sequence[str], doubles: Sequence[str], longs: Sequence[str] = ()) -> DataFrame:
    """Keys as they are (days as ISO text), doubles rounded, counts as bigint."""
    types = dict(df.dtypes)
    plain = [F.col(k).cast("string").alias(k) if types[k] in ("date", "timestamp") else F.col(k) for k in keys]
    return df.select(*plain, *[r6(c) for c in doubles], *[F.col(c).cast("bigint").alias(c) for c in longs])
