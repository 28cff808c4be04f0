"""Monthly reduced facts: per key, arrays of daily figures indexed by day of month."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIGURES = {"hit_array": "num_hits", "unique_visitors": "num_visitors"}


def daily_figures(
    events: DataFrame, key: str = "host", time: str = "event_time", visitor: str = "user_id"
) -> DataFrame:
    """Hits and distinct visitors per (key, day).

    The distinct count is aggregated by (key, day, visitor) first, so a hot key spreads over its
    visitors and a hot visitor shrinks map-side. Rows without a key belong to no entity.
    """
    return (
        events.filter(F.col(key).isNotNull())
        .groupBy(key, F.to_date(time).alias("day"))
        .agg(
            F.count(F.lit(1)).alias("num_hits"),
            F.count_distinct(F.col(visitor)).alias("num_visitors"),
        )
    )


def monthly_reduce_step(
    prev: DataFrame,
    events: DataFrame,
    month_start: dt.date,
    day: dt.date,
    key: str = "host",
    time: str = "event_time",
    visitor: str = "user_id",
    fill_zero: bool = False,
) -> DataFrame:
    """Reduced fact as of ``day`` from the one of the day before and the events of ``day``.

    A key first seen late is padded at the front, a day without events adds an empty element: NULL,
    or 0 with ``fill_zero``. Each array holds one element per day of the month so far.
    """
    _check_month(month_start, day)
    before = prev.filter(
        (F.col("month_start") == F.lit(month_start))
        & (F.col("date_partition") == F.lit(day - dt.timedelta(days=1)))
    ).select(key, *FIGURES, "first_found_date")
    today = daily_figures(events.filter(F.to_date(time) == F.lit(day)), key, time, visitor)
    empty = F.lit(0 if fill_zero else None).cast("bigint")
    padding = F.array_repeat(empty, (day - month_start).days)
    arrays = [
        F.concat(F.coalesce(array, padding), F.array(F.coalesce(figure, empty))).alias(array)
        for array, figure in FIGURES.items()
    ]
    return before.join(today, key, "full").select(
        key,
        *arrays,
        F.lit(month_start).alias("month_start"),
        F.least("first_found_date", "day").alias("first_found_date"),
        F.lit(day).alias("date_partition"),
    )


def monthly_history(
    events: DataFrame,
    month_start: dt.date,
    through: dt.date,
    key: str = "host",
    time: str = "event_time",
    visitor: str = "user_id",
    fill_zero: bool = False,
    since: dt.date | None = None,
) -> DataFrame:
    """Reduced facts of every day of the month up to ``through`` at once.

    ``since`` leaves out the snapshots of earlier days, not their figures.
    """
    _check_month(month_start, through)
    day = F.to_date(time)
    events = events.filter((day >= F.lit(month_start)) & (day <= F.lit(through)))
    daily = daily_figures(events, key, time, visitor)
    by_day = daily.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("day", F.struct(*FIGURES.values())))).alias(
            "by_day"  # at most 31 entries
        ),
        F.min("day").alias("first_found_date"),
    )
    empty = F.lit(0 if fill_zero else None).cast("bigint")
    days = F.sequence(F.lit(month_start), F.lit(through))

    def series(figure: str) -> Column:
        return F.transform(days, lambda d: F.coalesce(F.try_element_at("by_day", d)[figure], empty))

    # Each key gets its series of the whole month once; a snapshot is the front part of it.
    whole = by_day.select(
        key, "first_found_date", *(series(figure).alias(array) for array, figure in FIGURES.items())
    )
    start = F.greatest("first_found_date", F.lit(since or month_start))
    grid = whole.withColumn("date_partition", F.explode(F.sequence(start, F.lit(through))))
    elapsed = F.datediff("date_partition", F.lit(month_start)) + F.lit(1)
    return grid.select(
        key,
        *(F.slice(array, F.lit(1), elapsed).alias(array) for array in FIGURES),
        F.lit(month_start).alias("month_start"),
        "first_found_date",
        "date_partition",
    )


def _check_month(month_start: dt.date, day: dt.date) -> None:
    if month_start.day != 1 or (day.year, day.month) != (month_start.year, month_start.month):
        raise ValueError("day must lie in the month that starts on month_start")
