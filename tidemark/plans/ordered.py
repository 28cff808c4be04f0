"""Scans over the ordered rows of a key, split where one key holds too many rows.

A window function puts all rows of a key into one task. Here a hot key is cut into chunks that
follow its order; each chunk is scanned on its own, and only the borders meet afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.session import shared_dir
from tidemark.plans.skew import MAX_ROWS_PER_KEY, find_hot_keys

CHUNK, HOT, TIE = "_chunk", "_hot_n", "_tie"
CHUNKS_PER_TASK_LOAD = 4  # finer than the row bound asks for, since sampled ranges are not even

Lookup = Callable[[str], Column]


def asc(columns: Sequence[str]) -> list[Column]:
    """Ascending order with NULLs at the end."""
    return [F.col(name).asc_nulls_last() for name in columns]


def cut_hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    max_rows: int | None = MAX_ROWS_PER_KEY,
) -> tuple[DataFrame, bool]:
    """Add a chunk number that never falls along the order; tell whether any key needed a cut.

    Keys of at most ``max_rows`` rows stay whole (chunk 0). The rows of hot keys are cut into ranges of the whole order,
    by Spark's range partitioning: columns of any type, NULLs last, and a number for each row in the end, so that even
    rows equal in all of them are divided. The ranges are stored, since a lost task could draw other ones. ``max_rows=None``
    says that no key is large, as ``rows_bound`` found out or the key of the table implies.
    """
    hot = None if max_rows is None else find_hot_keys(df, keys, max_rows)
    if hot is None:
        return df.withColumn(CHUNK, F.lit(0)), False
    marked = hot.mark(df, HOT)
    large = _stored(
        marked.filter(F.col(HOT).isNotNull()).drop(HOT).withColumn(TIE, F.monotonically_increasing_id()), "hot-rows"
    )
    # Sampled ranges are uneven by a small factor; the ranges of all hot keys follow one another.
    parts = max(2, math.ceil(large.count() * CHUNKS_PER_TASK_LOAD / max_rows))
    ranges = large.repartitionByRange(parts, *asc([*keys, *order, TIE])).withColumn(CHUNK, F.spark_partition_id())
    cut = _stored(ranges.drop(TIE), "hot-ranges")
    usual = marked.filter(F.col(HOT).isNull()).drop(HOT).withColumn(CHUNK, F.lit(0))
    return usual.unionByName(cut), True


def _stored(df: DataFrame, purpose: str) -> DataFrame:
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collapse_runs(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    carry: Sequence[str],
    breaks: Callable[[Lookup, Lookup], Column],
    keep: Callable[[Lookup, Column], Column] | None = None,
    max_rows: int | None = MAX_ROWS_PER_KEY,
) -> DataFrame:
    """Collapse maximal runs of consecutive rows of a key into one row each.

    ``breaks(previous, current)`` tells whether the current row starts a new run; both arguments map
    a name from ``carry`` to a column. ``order`` must be unique within a key and part of ``carry``.
    Returns the keys, ``first_<c>`` and ``last_<c>`` for every carried column, and ``n_rows``.
    ``keep(first, n_rows)`` drops unwanted runs; inside a chunk it does so before the second shuffle.
    """
    keys, carry = list(keys), list(carry)
    rows = df.select(*dict.fromkeys([*keys, *carry]))
    rows, cut = cut_hot_keys(rows, keys, order, max_rows)
    rows = rows.withColumns({"_n": F.lit(1).cast("bigint"), "_glue": F.lit(True)})
    scan = Window.partitionBy(*keys, CHUNK).orderBy(*asc(order))
    runs = _scan_runs(rows, scan, carry, breaks, F.col, F.col)
    first: Lookup = lambda name: F.col(f"first_{name}")
    last: Lookup = lambda name: F.col(f"last_{name}")
    wanted = F.lit(True) if keep is None else F.coalesce(keep(first, F.col("_n")), F.lit(False))
    if cut:
        # A run inside its chunk is final. The first and the last run of each chunk, at most two
        # per chunk, go to one lane per key, where neighbours across a chunk border are joined.
        border = F.col("_opens") | F.col("_closes")
        pieces = runs.filter(border | wanted).withColumns(
            {"_lane": F.when(~border, F.col(CHUNK)), "_glue": F.col("_opens")}
        )
        lane = Window.partitionBy(*keys, "_lane").orderBy(
            F.col(CHUNK), *(first(name).asc_nulls_last() for name in order)
        )
        runs = _scan_runs(pieces, lane, carry, breaks, first, last)
    return runs.filter(wanted).select(
        *keys,
        *(first(name).alias(f"first_{name}") for name in carry),
        *(last(name).alias(f"last_{name}") for name in carry),
        F.col("_n").alias("n_rows"),
    )


def _scan_runs(pieces, window, carry, breaks, first: Lookup, last: Lookup) -> DataFrame:
    """One scan: mark the pieces that start a run, then keep the last piece of each run.

    A piece is a row or a run of an earlier scan. One whose ``_glue`` is False never joins the piece
    before it. ``_opens`` and ``_closes`` tell that a run touches the start or end of the window
    partition. All functions share one window, hence one shuffle and one sort.
    """
    sofar = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = breaks(lambda name: F.lag(last(name)).over(window), first)
    marked = pieces.withColumns({"_at": F.row_number().over(window), "_cut": cuts})
    marked = marked.withColumn(
        "_starts",
        (F.col("_at") == 1) | ~F.col("_glue") | F.coalesce(F.col("_cut"), F.lit(True)),
    )
    marked = marked.withColumns(
        {
            "_total": F.sum("_n").over(sofar),
            "_next": F.lead("_starts").over(window),
        }
    )
    start = F.struct(
        F.col("_at"),
        (F.col("_total") - F.col("_n")).alias("_before"),
        *(first(name).alias(name) for name in carry),
    )
    marked = marked.withColumn(
        "_start", F.last(F.when(F.col("_starts"), start), ignorenulls=True).over(sofar)
    )
    ends = marked.filter(F.coalesce(F.col("_next"), F.lit(True)))
    found = {
        "_n": F.col("_total") - F.col("_start._before"),
        "_opens": F.col("_start._at") == 1,
        "_closes": F.col("_next").isNull(),
    }
    found |= {f"last_{name}": last(name) for name in carry}
    found |= {f"first_{name}": F.col(f"_start.{name}") for name in carry}
    return ends.withColumns(found)


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Add ``position``, the 1-based place of a row in its key, to a frame with chunk numbers.

    Chunks are counted first (map-side); the number of rows in earlier chunks then joins the rows of
    the chunk as one extra marker row, so no group larger than a chunk is formed and NULL keys work.
    """
    keys = list(keys)
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, CHUNK)
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .drop("_size")
    )
    marked = df.withColumn("_row", F.lit(True)).unionByName(offsets, allowMissingColumns=True)
    scan = Window.partitionBy(*keys, CHUNK).orderBy(F.col("_row").asc_nulls_first(), *asc(order))
    local = F.row_number().over(scan) - F.lit(1)
    offset = F.max("_offset").over(scan.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        marked.withColumn("position", local + offset).filter("_row").drop("_row", "_offset")
    )
