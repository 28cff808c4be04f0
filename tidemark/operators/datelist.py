"""Lists of active dates per key, and their bitmaps."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.bits import datelist_bits
from tidemark.plans.skew import broadcast_if_small

DEVICE = ("user_id", "device_id")
USER_DEVICE = (*DEVICE, "browser_type")


def active_days(events: DataFrame, keys: Sequence[str], time: str = "event_time") -> DataFrame:
    """Distinct (key, day) pairs as ``date_active``. Rows with a NULL key belong to no entity."""
    known = reduce(Column.__and__, (F.col(key).isNotNull() for key in keys))
    return events.filter(known).select(*keys, F.to_date(time).alias("date_active")).distinct()


def device_days(events: DataFrame, time: str = "event_time") -> DataFrame:
    """Active days per (user, device), ids as text, for events with a user."""
    days = active_days(events, DEVICE, time)
    return days.withColumns({name: F.col(name).cast("string") for name in DEVICE})


def with_browsers(lists: DataFrame, devices: DataFrame) -> DataFrame:
    """Rows per (user, device) for each browser of the device.

    All browsers of a device have its days, so lists and bitmaps are built, stored and advanced per (user, device) and
    fan out where they are read: nothing is shuffled after that if the browsers are few enough to be broadcast.
    """
    browsers = devices.select(F.col("device_id").cast("string"), "browser_type").distinct()
    known = broadcast_if_small(browsers.filter(F.col("browser_type").isNotNull()))
    others = [c for c in lists.columns if c not in DEVICE]
    return lists.join(known, "device_id").select(*USER_DEVICE, *others)


def user_device_days(events: DataFrame, devices: DataFrame, time: str = "event_time") -> DataFrame:
    """Active days per (user, device, browser), ids as text, for events with a user.

    Events shrink to distinct days and devices to distinct browsers before they are joined, so
    repeated events or device rows never multiply.
    """
    days = active_days(events, ["user_id", "device_id"], time)
    browsers = devices.select(F.col("device_id").cast("string"), "browser_type").distinct()
    ids = {name: F.col(name).cast("string") for name in ("user_id", "device_id")}
    joined = days.withColumns(ids).join(broadcast_if_small(browsers), "device_id")
    return joined.filter(F.col("browser_type").isNotNull()).select(*USER_DEVICE, "date_active")


def cumulate_dates(
    prev: DataFrame,
    days: DataFrame,
    keys: Sequence[str],
    day: dt.date,
    newest_first: bool = True,
    keep_inactive: bool = True,
) -> DataFrame:
    """Date lists as of ``day`` from those of the day before and the active days.

    Keys without activity keep their list; with ``keep_inactive=False`` they drop out of the
    snapshot. A key needs no more than one entry per day, so lists are bounded by the calendar.
    """
    today = (
        days.filter(F.col("date_active") == F.lit(day)).select(*keys, "date_active").distinct()
    )
    before = prev.filter(F.col("date") == F.lit(day - dt.timedelta(days=1)))
    none = F.array().cast("array<date>")
    old = F.coalesce("dates_active", none)
    new = F.when(F.col("date_active").isNull(), none).otherwise(F.array("date_active"))
    merged = before.select(*keys, "dates_active").join(
        today, list(keys), "full" if keep_inactive else "right"
    )
    return merged.select(
        *keys,
        (F.concat(new, old) if newest_first else F.concat(old, new)).alias("dates_active"),
        F.lit(day).alias("date"),
    )


def datelist_history(
    days: DataFrame,
    keys: Sequence[str],
    through: dt.date,
    newest_first: bool = True,
    first_day: dt.date | None = None,
) -> DataFrame:
    """Date lists of every day up to ``through`` at once, from each key's first active day on.

    ``first_day`` leaves out the snapshots of earlier days, not their dates. A list changes only on
    active days, so it is built once per active day and repeated until the next one.
    """
    lists = (
        days.filter(F.col("date_active") <= F.lit(through))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set("date_active")).alias("all_dates"))
    )
    spans = lists.select(*keys, "all_dates", F.posexplode("all_dates").alias("place", "since"))
    following = F.try_element_at("all_dates", F.col("place") + F.lit(2))
    until = F.coalesce(F.date_sub(following, 1), F.lit(through))
    since = F.col("since") if first_day is None else F.greatest("since", F.lit(first_day))
    sofar = F.slice("all_dates", F.lit(1), F.col("place") + F.lit(1))
    return (
        spans.select(
            *keys,
            (F.reverse(sofar) if newest_first else sofar).alias("dates_active"),
            since.alias("since"),
            until.alias("until"),
        )
        .filter(F.col("since") <= F.col("until"))
        .select(*keys, "dates_active", F.explode(F.sequence("since", "until")).alias("date"))
    )


def bitmap_step(
    prev: DataFrame, days: DataFrame, keys: Sequence[str], day: dt.date, n: int = 32
) -> DataFrame:
    """Bitmaps as of ``day`` from those of the day before and the active days.

    All bits move one day back, the oldest falls off, and the highest is set for keys that were active. Keys of the day
    before stay, with a bitmap of 0 after ``n`` days without activity. Only rows of ``day`` are read from ``days``.
    """
    today = days.filter(F.col("date_active") == F.lit(day)).select(*keys, F.lit(True).alias("active")).distinct()
    before = prev.filter(F.col("date") == F.lit(day - dt.timedelta(days=1))).select(*keys, "datelist_int")
    bits = F.shiftright(F.coalesce("datelist_int", F.lit(0).cast("bigint")), 1)
    newest = F.when(F.col("active"), F.lit(1 << (n - 1)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return before.join(today, list(keys), "full").select(
        *keys, bits.bitwiseOR(newest).alias("datelist_int"), F.lit(day).alias("date")
    )


def datelist_int(
    df: DataFrame,
    keys: Sequence[str],
    as_of: dt.date,
    dates: str = "dates_active",
    n: int = 32,
    top: int | None = None,
) -> DataFrame:
    """Bitmap of the last ``n`` days per key of the snapshot of ``as_of``: no join, no shuffle."""
    day = F.lit(as_of)
    return df.filter(F.col("date") == day).select(
        *keys, datelist_bits(dates, day, n, top).alias("datelist_int"), day.alias("date")
    )
