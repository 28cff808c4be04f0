"""CSV datasets and bucketed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.plans.skew import HotKeys, measured


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """CSV with a header line.

    With a schema nothing is read to guess types, and a header with other names or another order, as
    well as a malformed row, is an error; without one Spark infers types with an extra pass.
    """
    reader = spark.read.option("header", True)
    reader = reader.option("inferSchema", True) if schema is None else (
        reader.schema(schema).option("enforceSchema", False).option("mode", "FAILFAST")
    )
    return reader.csv(path)


def bucket_count(df: DataFrame, least: int = 16, bucket_bytes: int = 128 * 1024 * 1024) -> int:
    """Buckets or files for ``df``: at least ``least``, and about ``bucket_bytes`` of rows in each."""
    return max(least, -(-measured(df)[1] // bucket_bytes))


def write_bucketed(
    df: DataFrame,
    table: str,
    key: str,
    n: int = 16,
    path: str | None = None,
    replace: bool = True,
    hot: Sequence[HotKeys | None] = (),
) -> str:
    """Save ``df`` as a Parquet table in ``n`` buckets of ``key``; return the table name.

    Tables to be joined need the same ``n``: choose it so that one bucket of the largest fits a
    task. Rows are shuffled to their buckets first, which leaves one file per bucket instead of one
    per bucket and task. ``path`` places the files, else the warehouse folder is used.

    A bucket is read by one task. With ``hot`` key lists the table gets a partition column ``hot``:
    rows of those keys are stored apart, in several files per bucket, and a join can treat them on
    its own.
    """
    lists = [keys for keys in hot if keys is not None]
    if lists:
        marked, parts = df.withColumn("hot", F.lit(False)), F.lit(1)
        for number, keys in enumerate(lists):
            marked = keys.mark(marked, f"_hot_{number}")
            found = F.col(f"_hot_{number}")
            marked = marked.withColumn("hot", F.col("hot") | found.isNotNull())
            parts = F.greatest(parts, keys.parts(f"_hot_{number}"))
        bucket = F.pmod(F.hash(key), F.lit(n))
        part = F.pmod(F.xxhash64(*df.columns), parts)
        spread = marked.repartition(n, bucket, "hot", part).select(*df.columns, "hot")
        writer = spread.write.partitionBy("hot")
    else:
        writer = df.repartition(n, key).write
    writer = writer.bucketBy(n, key).format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.mode("overwrite" if replace else "errorifexists").saveAsTable(table)
    return table
