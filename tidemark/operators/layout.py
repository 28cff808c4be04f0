"""Written size of the same rows under different layouts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY_FIGURES = ("keys", "files_of_a_key", "unsorted")
BLOCK = 1 << 16  # rows of a file whose order is looked at together


def arrange(
    df: DataFrame, keys: Sequence[str], parts: int = 16, by: str = "range", ties: Sequence[str] = ()
) -> DataFrame:
    """Rows in ``parts`` partitions, sorted inside each by ``keys`` and ``ties``.

    ``by="hash"`` puts all rows of a key into one partition. ``by="range"`` cuts the sort order into
    even pieces, so a key with most of the rows fills several partitions; ``ties`` make such keys
    divisible.
    """
    if by == "hash":
        spread = df.repartition(parts, *keys)
    elif by == "range":
        spread = df.repartitionByRange(parts, *keys, *ties)
    else:
        raise ValueError("by must be 'range' or 'hash'")
    return spread.sortWithinPartitions(*keys, *ties)


def layout_report(
    df: DataFrame,
    layouts: Mapping[str, Sequence[str]],
    path: str,
    parts: int = 16,
    by: str = "range",
    ties: Sequence[str] = (),
) -> DataFrame:
    """Write ``df`` once per layout below ``path``; report figures of the written files, smallest first.

    ``rows``, ``files`` and ``bytes``; ``keys``, the distinct values of the layout's keys; ``files_of_a_key``, the
    most files that one of them is in; ``unsorted``, the rows that come before a smaller key in their file. The last
    three are NULL for a layout without keys. An empty key list writes the rows as they come; it goes first, and the
    other layouts are then made from its files instead of computing ``df`` again.
    """
    spark = df.sparkSession
    reports, orders = [], []
    for name, keys in sorted(layouts.items(), key=lambda item: bool(item[1])):
        target = f"{path.rstrip('/')}/{name}"
        shaped = arrange(df, keys, parts, by, ties) if keys else df.repartition(parts)
        shaped.write.mode("overwrite").parquet(target)
        if not keys:
            df = spark.read.schema(df.schema).parquet(target)
        stored = spark.read.schema(df.schema).parquet(target)
        reports.append(_file_figures(stored).withColumn("layout", F.lit(name)))
        if keys:
            orders.append(_key_figures(stored, keys).withColumn("layout", F.lit(name)))
    report = reduce(DataFrame.unionByName, reports)
    if orders:
        report = report.join(reduce(DataFrame.unionByName, orders), "layout", "left")
    else:
        report = report.withColumns({c: F.lit(None).cast("bigint") for c in KEY_FIGURES})
    return report.select("layout", "rows", "files", "bytes", *KEY_FIGURES).orderBy("bytes", "layout")


def _file_figures(stored: DataFrame) -> DataFrame:
    files = stored.groupBy("_metadata.file_path").agg(
        F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("bytes")
    )
    return files.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.count_if(F.col("rows") > 0).alias("files"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    )


def _key_figures(stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Figures of the order in the files.

    Rows are compared with those before them in blocks of ``BLOCK`` row numbers, and the first of each block with the last of
    the block before, so no task has to sort a whole file.
    """
    rows = stored.select(
        F.struct(*keys).alias("key"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")
    )
    by_key = rows.groupBy("key", "file").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count(F.lit(1)).alias("files"))
    held = by_key.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.max("files"), F.lit(0)).alias("files_of_a_key"))

    def falls(before: Column, key: Column) -> Column:
        return F.coalesce(before > key, F.lit(False))

    blocks = rows.withColumn("block", F.floor(F.col("at") / BLOCK))
    before = F.lag("key").over(Window.partitionBy("file", "block").orderBy("at"))
    inside = blocks.withColumn("falls", falls(before, F.col("key"))).groupBy("file", "block").agg(
        F.count_if("falls").alias("falls"), F.min_by("key", "at").alias("first"), F.max_by("key", "at").alias("last")
    )
    last = F.lag("last").over(Window.partitionBy("file").orderBy("block"))
    borders = inside.withColumn("falls", F.col("falls") + falls(last, F.col("first")).cast("int"))
    return held.crossJoin(borders.agg(F.coalesce(F.sum("falls"), F.lit(0)).alias("unsorted")))
