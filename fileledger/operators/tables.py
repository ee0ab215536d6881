"""Small table helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_row(*totals: DataFrame) -> DataFrame:
    """Put one-row totals with different columns into a single row, without a join."""
    names = [c for t in totals for c in t.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), totals)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])
