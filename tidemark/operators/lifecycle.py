"""Lifecycle states: who is new, stays, leaves, stays away or comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the states.
NEW = "New"
CONTINUED = "Continued Playing"
RETIRED = "Retired"
RETURNED = "Returned from Retirement"
STAYED_RETIRED = "Stayed Retired"


def _members(rows: DataFrame, key: str, period: str) -> DataFrame:
    return rows.filter(F.col(key).isNotNull()).select(key, period).distinct()


def lifecycle_step(
    prev: DataFrame,
    current: DataFrame,
    period: int,
    key: str = "player_name",
    period_column: str = "season",
) -> DataFrame:
    """States of ``period`` from those of ``period - 1`` and the rows of ``period``."""
    before = prev.filter(F.col(period_column) == period - 1).select(key, "status")
    now = _members(current.filter(F.col(period_column) == period), key, period_column)
    present = F.col(period_column).isNotNull()
    away = F.col("status").isin(RETIRED, STAYED_RETIRED)
    return before.join(now, key, "full").select(
        key,
        _state(F.col("status").isNull(), ~away, present).alias("status"),
        F.lit(period).alias(period_column),
    )


def lifecycle_history(
    rows: DataFrame,
    through: int,
    key: str = "player_name",
    period: str = "season",
    since: int | None = None,
) -> DataFrame:
    """States of every period up to ``through`` at once, from each key's first period on.

    ``since`` leaves out the states of earlier periods.
    The state follows from presence in this period and the one before, so one grouping by key, of
    at most one entry per period, is enough: no window, no chain of joins.
    """
    seen = (
        _members(rows.filter(F.col(period) <= through), key, period)
        .groupBy(key)
        .agg(F.collect_set(period).alias("seen"))
    )
    start = F.array_min("seen")
    if since is not None:
        start = F.greatest(start, F.lit(since))
    grid = seen.withColumn(period, F.explode(F.sequence(start, F.lit(through))))
    now, before = (F.array_contains("seen", F.col(period) - F.lit(back)) for back in (0, 1))
    first = F.col(period) == F.array_min("seen")
    return grid.select(key, _state(first, before, now).alias("status"), period)


def _state(first: Column, playing_before: Column, present: Column) -> Column:
    return (
        F.when(first, NEW)
        .when(playing_before, F.when(present, CONTINUED).otherwise(RETIRED))
        .otherwise(F.when(present, RETURNED).otherwise(STAYED_RETIRED))
    )
