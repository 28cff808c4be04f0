"""Table profile and key check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def profile(
    df: DataFrame,
    columns: Sequence[str],
    where: Column | None = None,
    by: Sequence[str | Column] = (),
) -> DataFrame:
    """Rows, non-null values, distinct values and maximum per column, optionally per group.

    One pass; Spark combines every count map-side before it shuffles.
    """
    df = df if where is None else df.filter(where)
    figures = [F.count(F.lit(1)).alias("n_rows")]
    for name in columns:
        figures += [
            F.count(name).alias(f"{name}_non_null"),
            F.count_distinct(F.col(name)).alias(f"{name}_distinct"),
            F.max(name).alias(f"{name}_max"),
        ]
    return df.groupBy(*by).agg(*figures)


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their count: empty where the key holds."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
