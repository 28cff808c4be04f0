"""Streaming queries: where results go and how a run is started."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from tidemark.sources.jdbc import write_jdbc
from tidemark.sources.store import KeyedTable

# Fixed value: time between two state checkpoints.
INTERVAL = "100 seconds"


def _start(
    writer: DataStreamWriter, checkpoint: str, interval: str | None, mode: str = "append"
) -> StreamingQuery:
    writer = writer.outputMode(mode).option("checkpointLocation", checkpoint)
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


def append_to_files(
    counts: DataFrame, path: str, checkpoint: str, interval: str | None = INTERVAL
) -> StreamingQuery:
    """Append finished windows to Parquet, exactly once. ``interval=None`` reads what is there."""
    return _start(counts.writeStream.format("parquet").option("path", path), checkpoint, interval)


def append_to_jdbc(
    counts: DataFrame,
    options: Mapping[str, str],
    checkpoint: str,
    interval: str | None = INTERVAL,
    write: Callable[[DataFrame, Mapping[str, str]], None] = write_jdbc,
) -> StreamingQuery:
    """Append finished windows to a JDBC table batch by batch.

    A batch that fails half way is written again: give the table a key on window and entity if
    repeated rows matter.
    """
    writer = counts.writeStream.foreachBatch(lambda batch, _: write(batch, options))
    return _start(writer, checkpoint, interval)


def upsert_to_table(
    rows: DataFrame,
    table: KeyedTable,
    checkpoint: str,
    interval: str | None = INTERVAL,
    mode: str = "update",
    sums: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Put the rows of a stream in the place of stored ones with their key, each batch exactly once.

    With ``sums`` each batch is summed up by it first, and the sums are added to the stored ones: a running aggregate
    over the rows of a stream in append mode, whose state is the table. The number of a batch is published with its rows, under the id that the checkpoint gives the stream. So a batch that
    is sent again, after a crash between the table and the checkpoint, changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        known = (batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"), number)
        if table.has_batch(*known):
            batch.write.format("noop").mode("overwrite").save()  # its state has to be brought up to date all the same
        else:
            table.upsert(batch if sums is None else sums(batch), known, add=sums is not None)

    return _start(rows.writeStream.foreachBatch(write), checkpoint, interval, mode)
