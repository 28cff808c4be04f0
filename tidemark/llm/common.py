"""Helpers that the operators share: tables, stored intermediate results, Arrow batches."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.session import shared_dir


#: Nodes of plans whose rows come in the same order in every scan.
STORED = {"Project", "Filter", "LogicalRelation", "LocalRelation", "LogicalRDD", "Range", "DataSourceV2ScanRelation"}

GATHERED = 16 << 20  # bytes read for a file of small rows


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def column(name: str) -> Column:
    """The column of that very name, dots included."""
    return F.col(f"`{name.replace('`', '``')}`")


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe from lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame, purpose: str) -> DataFrame:
    """``staged`` for rows of a few numbers: a file for each 16 MB of the files read for them, not one for each task.

    In a local file system Hadoop starts a process for the rights of each file and folder. Until that runs its own program it
    shares the executor's memory, which then counts twice, so hundreds of tiny files are more than they look.
    """
    plan = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    leaves = [plan.apply(i) for i in range(plan.size())]
    if not all(leaf.getClass().getSimpleName() in ("LogicalRelation", "LocalRelation") for leaf in leaves):
        return staged(df, purpose)  # the size of others is not known
    read = sum(int(str(leaf.stats().sizeInBytes())) for leaf in leaves)
    return staged(df.repartition(max(1, -(-read // GATHERED))), purpose)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df``, a stored table, with a number for each row by its place, the same in every scan.

    Spark cuts small tables into as many parts as there are cores, so a lost executor between two scans would
    change the numbers. The session's number of parts is therefore held from here on, if it is not set. A frame that
    is more than columns and filters of stored rows is refused, since its rows may come in another order each time.
    """
    spark = df.sparkSession
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind not in STORED:
            raise ValueError(f"row numbers need a stored table, not the result of {kind}: write it and read it back")
        todo += [node.children().apply(i) for i in range(node.children().size())]
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))
    return df.withColumn(name, F.monotonically_increasing_id())


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has; case does not count."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def discard(df: DataFrame) -> None:
    """Delete the files of a ``staged`` frame that nothing will read any more."""
    spark = df.sparkSession
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs.

    It does once the driver's garbage collector finds that nothing refers to a shuffle any more, which may take half an
    hour by itself. Called after large jobs, so that their files do not stay beside those of the next one. The frames that
    Python gave up are let go by the JVM a little later, so those of the last job are found by a second collection only.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)
    spark.sparkContext._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in small parts, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most ``rows`` rows in an Arrow batch while jobs run in this block.

    For rows that carry whole tiles of data; the setting before is restored.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def lists(values: pa.Array) -> list[np.ndarray]:
    """The lists of an Arrow list column without null elements as numpy views."""
    flat = values.values.to_numpy(zero_copy_only=False)  # offsets count from its start, in a slice too
    offsets = values.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def schema_of(df: DataFrame, **more: T.DataType) -> T.StructType:
    """Schema of ``df`` with more columns."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in more.items())])
