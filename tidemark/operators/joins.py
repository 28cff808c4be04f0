"""Lookup, bucketed and enrichment joins."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.skew import (
    MAX_BROADCAST_BYTES,
    MAX_BROADCAST_ROWS,
    HotKeys,
    broadcast_if_small,
    salted_join,
)

MATCH_COLUMNS = (
    "is_team_game", "playlist_id", "game_variant_id", "is_match_over", "completion_date",
    "match_duration", "game_mode", "map_variant_id",
)


def broadcast_lookup(
    fact: DataFrame,
    dim: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Join with an explicit broadcast of ``dim``, after its size was checked.

    A larger dimension is joined by shuffle; AQE then splits skewed partitions of ``fact``.
    """
    return fact.join(broadcast_if_small(dim, max_rows, max_bytes), on, how)


def bucketed_match_join(
    spark: SparkSession,
    medals: str,
    details: str,
    matches: str,
    hot_medals: HotKeys | None = None,
    hot_details: HotKeys | None = None,
) -> DataFrame:
    """Medals with all detail rows of their match and the match itself, from bucketed tables.

    Written as medals ⟕ (details ⟕ matches): every join keeps the bucketing of ``match_id``, so no
    table is shuffled. In the order (medals ⟕ details) ⟕ matches the key of the last join comes from
    the nullable side and costs an exchange; the rows are the same, since a medal without details
    has no match columns either way.

    A bucket cannot be split at run time. Matches in one of the ``hot`` lists, for which the tables
    must have been written with those lists, are joined apart with salts.
    """
    a = spark.table(medals).withColumnRenamed("player_gamertag", "player_gamertag_medal")
    # The match of the detail row, NULL where a medal has none.
    b = spark.table(details).withColumn("detail_match_id", F.col("match_id"))
    c = spark.table(matches)
    if hot_medals is None and hot_details is None:
        joined = a.join(b.join(c, "match_id", "left"), "match_id", "left")
    else:
        usual, large = (
            [df.filter(F.col("hot") == flag).drop("hot") for df in (a, b, c)]
            for flag in (False, True)
        )
        joined = usual[0].join(usual[1].join(usual[2], "match_id", "left"), "match_id", "left")
        described = salted_join(large[1], large[2], "match_id", hot_left=hot_details)
        joined = joined.unionByName(
            salted_join(large[0], described, "match_id", "left", hot_medals, hot_details)
        )
    return joined.select(
        "player_gamertag_medal", "medal_id", "count", F.col("detail_match_id").alias("match_id"),
        "player_gamertag", "player_total_kills", *MATCH_COLUMNS,
    )


def enrich_location(
    events: DataFrame, locations: DataFrame, ip: str = "ip", into: str = "geodata"
) -> DataFrame:
    """Add country, state and city of an ip as JSON text; ``{}`` for an unknown ip.

    ``locations`` has one row per ip; a missing part becomes an empty string. The events are scanned
    once and call no outside service.
    """
    parts = ("country", "state", "city")
    located = locations.select(
        ip, F.to_json(F.struct(*(F.coalesce(p, F.lit("")).alias(p) for p in parts))).alias(into)
    )
    return broadcast_lookup(events.drop(into), located, ip).withColumn(
        into, F.coalesce(into, F.lit("{}"))
    )


def device_history(changes: DataFrame, key: str = "device_id", changed: str = "changed") -> DataFrame:
    """Versions of each device with the time from which (``since``) and before which (``until``) they hold.

    A version holds until the next change of its device, the last one without end. Of changes at the same time the
    first in the order of all columns counts. A device without a key or time is none.
    """
    others = [c for c in changes.columns if c not in (key, changed)]
    known = changes.filter(F.col(key).isNotNull() & F.col(changed).isNotNull())
    version = F.min(F.struct(*others)).alias("version")  # one for each device and time, combined map-side
    versions = known.groupBy(key, changed).agg(version)
    until = F.lead(changed).over(Window.partitionBy(key).orderBy(changed))
    return versions.select(key, F.col(changed).alias("since"), until.alias("until"), "version.*")


def enrich_events(
    events: DataFrame, devices: DataFrame, day: dt.date, time: str = "event_time"
) -> DataFrame:
    """Events of ``day`` by signed-in users with browser, device type and system of their device.

    The day reaches the scan as a range. ``devices`` with ``since`` and ``until``, as ``device_history`` gives them, are
    matched by time too, on versions that hold on that day: one row for each event, since versions do not overlap. Without
    them there is one row for each matching device row.
    """
    signed_in = events.filter((F.to_date(time) == F.lit(day)) & F.col("user_id").isNotNull())
    wanted = ["device_id", "browser_type", "device_type", "os_type"]
    if not {"since", "until"} <= set(devices.columns):
        return broadcast_lookup(signed_in, devices.select(*wanted), "device_id", "inner")
    begin, end = (F.lit(d).cast("timestamp_ntz") for d in (day, day + dt.timedelta(days=1)))
    today = devices.filter((F.col("since") < end) & (F.col("until").isNull() | (F.col("until") > begin)))
    versions = broadcast_if_small(today.select(*wanted, "since", "until"))
    joined = signed_in.join(versions, "device_id")
    at = F.col(time)
    return joined.filter((at >= F.col("since")) & (F.col("until").isNull() | (at < F.col("until")))).drop("since", "until")
