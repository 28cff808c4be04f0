"""Tumbling and session counts, the same functions for streams and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.ordered import collapse_runs
from tidemark.plans.skew import MAX_ROWS_PER_KEY

TIME = "window_timestamp"
KEYS = ("ip", "host")


def tumbling_counts(
    events: DataFrame,
    keys: Sequence[str] = KEYS,
    width: str = "5 minutes",
    lateness: str | None = "15 seconds",
    time: str = TIME,
) -> DataFrame:
    """Events per window and key. Counts are combined before the shuffle, so hot keys stay cheap.

    A stream without ``lateness`` never closes a window: for a sink that takes updates.
    """
    events = events.filter(F.col(time).isNotNull())
    if events.isStreaming and lateness is not None:
        events = events.withWatermark(time, lateness)
    counts = events.groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("num_logs"))
    return counts.select(*keys, F.col("window.start").alias("window_start"), "num_logs")


def session_counts(
    events: DataFrame,
    keys: Sequence[str] = KEYS,
    gap: str = "5 minutes",
    lateness: str = "15 seconds",
    time: str = TIME,
    max_rows: int | None = MAX_ROWS_PER_KEY,
) -> DataFrame:
    """Events per session and key; a session ends after ``gap`` without an event.

    ``window_end`` is the last event plus the gap; an event at that very moment starts a new
    session. On a stream this is Spark's session window, emitted once the watermark passes. On a
    table the sessions are runs of ordered events, and keys over ``max_rows`` rows are cut.
    """
    events = events.filter(F.col(time).isNotNull())
    if events.isStreaming:
        window = F.session_window(time, gap)
        counts = (
            events.withWatermark(time, lateness)
            .groupBy(window, *keys)
            .agg(F.count(F.lit(1)).alias("num_logs"))
        )
        return counts.select(
            *keys,
            F.col("session_window.start").alias("window_start"),
            F.col("session_window.end").alias("window_end"),
            "num_logs",
        )
    pause = F.expr(f"INTERVAL {gap}")
    # Events of one key at the same instant are alike here, so their order does not matter.
    runs = collapse_runs(
        events, keys, [time], [time],
        breaks=lambda before, now: now(time) >= before(time) + pause,
        max_rows=max_rows,
    )
    return runs.select(
        *keys,
        F.col(f"first_{time}").alias("window_start"),
        (F.col(f"last_{time}") + pause).alias("window_end"),
        F.col("n_rows").alias("num_logs"),
    )


def session_sums(sessions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sessions and their events per key, as sums that go on from batch to batch."""
    return sessions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("num_logs").cast("bigint").alias("logs")
    )


def averages_of_sums(sums: DataFrame) -> DataFrame:
    """``average_session_size`` from the sums of ``session_sums``."""
    average = sums.withColumn("avg_events", F.col("logs") / F.col("sessions")).drop("logs", "sessions")
    return average.withColumn("avg_events_int", F.floor("avg_events").cast("bigint"))


def average_session_size(
    sessions: DataFrame, keys: Sequence[str] = KEYS, host_like: str | None = None
) -> DataFrame:
    """Average events per session and key, as a fraction and as a whole number cut towards zero.

    ``host_like`` keeps the hosts that match a LIKE pattern.
    """
    if host_like is not None:
        sessions = sessions.filter(F.col("host").like(host_like))
    averages = sessions.groupBy(*keys).agg(F.avg("num_logs").alias("avg_events"))
    return averages.withColumn("avg_events_int", F.floor("avg_events").cast("bigint"))
