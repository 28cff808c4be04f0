"""Type-2 slowly changing dimensions: closed intervals of unchanged attributes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.ordered import collapse_runs

TRACKED = ("quality_class", "is_active")


def scd2_backfill(
    df: DataFrame,
    as_of: int,
    key: str = "actorid",
    period: str = "current_year",
    tracked: Sequence[str] = TRACKED,
    max_rows: int | None = None,
) -> DataFrame:
    """All intervals from a snapshot table that holds one row per (key, period).

    A key has at most as many rows as there are periods; ``max_rows`` cuts keys for which that is
    too many for one task. Only periods up to ``as_of`` are read. Attributes are compared null-safe:
    a change to or from NULL starts an interval, NULL after NULL does not. A NULL key has no history.
    """

    def changed(before, now) -> Column:
        return ~reduce(Column.__and__, (before(c).eqNullSafe(now(c)) for c in tracked))

    runs = collapse_runs(
        df.filter((F.col(period) <= as_of) & F.col(key).isNotNull()), [key], [period], [period, *tracked], changed,
        max_rows=max_rows,
    )
    return runs.select(
        key,
        *(F.col(f"last_{c}").alias(c) for c in tracked),
        F.col(f"first_{period}").alias("start_year"),
        F.col(f"last_{period}").alias("end_year"),
        F.lit(as_of).alias("current_year"),
    )


def scd2_step(
    scd: DataFrame,
    current: DataFrame,
    period: int,
    key: str = "actorid",
    period_column: str = "current_year",
    tracked: Sequence[str] = TRACKED,
    drop_missing: bool = False,
) -> DataFrame:
    """Intervals as of ``period`` from those as of ``period - 1`` and the snapshot of ``period``.

    Closed intervals pass through. An open interval is extended if nothing changed, otherwise it is
    closed and a new one opened; new entities open one. An entity missing from the snapshot keeps
    its interval as it was, or loses it with ``drop_missing``. All four cases come from one full
    join: each side is shuffled once. Rows with a NULL key are left out.
    """
    state = [key, *tracked, "start_year", "end_year"]
    known, marker = F.col(key).isNotNull(), F.lit(True).alias("present")
    last = scd.filter((F.col("current_year") == period - 1) & known).select(*state)
    closed = last.filter(F.col("end_year") < period - 1)
    before = last.filter(F.col("end_year") == period - 1).select("*", marker).alias("before")
    now = current.filter((F.col(period_column) == period) & known).select(key, *tracked, marker).alias("now")

    def interval(side: str, start: Column, end: Column) -> Column:
        return F.struct(
            *(F.col(f"{side}.{c}").alias(c) for c in tracked),
            start.cast("int").alias("start_year"),
            end.cast("int").alias("end_year"),
        )

    start, this = F.col("before.start_year"), F.lit(period)
    old = interval("before", start, F.col("before.end_year"))
    extended, opened = interval("before", start, this), interval("now", this, this)
    same = reduce(
        Column.__and__, (F.col(f"before.{c}").eqNullSafe(F.col(f"now.{c}")) for c in tracked)
    )
    intervals = (
        F.when(F.col("before.present").isNull(), F.array(opened))
        .when(F.col("now.present").isNull(), F.array() if drop_missing else F.array(old))
        .when(same, F.array(extended))
        .otherwise(F.array(old, opened))
    )
    merged = before.join(now, F.col(f"before.{key}") == F.col(f"now.{key}"), "full").select(
        F.coalesce(f"before.{key}", f"now.{key}").alias(key), F.inline(intervals)
    )
    return closed.unionByName(merged).withColumn("current_year", this)
