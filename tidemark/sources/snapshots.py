"""Snapshot store: one partition per period of a cumulative table on Parquet."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.versions import observed


def write_snapshot(
    df: DataFrame, path: str, period_column: str, rebalance: bool = True, period: Any = None
) -> None:
    """Replace the periods that ``df`` holds, keep all others; a rerun gives the same table.

    With ``period`` the rows are those of that period, and if there are none, what an earlier run
    has stored for it goes too.

    Dynamic partition overwrite is set on this very write: with the session default a rerun would
    delete the other periods, among them the one being read. ``rebalance`` gathers each period in
    few files and lets AQE split a period that is large; without AQE rows are written as they come.
    """
    adaptive = df.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true"
    seen = Observation()
    if period is not None:  # counted in the write itself: the rows are not computed again
        df = df.observe(seen, F.count_if(F.col(period_column) == F.lit(period)).alias("rows"))
    df = df.hint("rebalance", F.col(period_column)) if rebalance and adaptive else df
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(period_column)
        .parquet(path)
    )
    if period is not None and not observed(seen).get("rows"):
        store, place = _folder(df.sparkSession, f"{path}/{period_column}={period}")
        if store.exists(place):
            store.delete(place, True)


def _folder(spark: SparkSession, path: str):
    """The file system of ``path`` and the path, as Hadoop has them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def read_snapshot(
    spark: SparkSession,
    path: str,
    schema: StructType,
    period_column: str | None = None,
    period: Any = None,
) -> DataFrame:
    """The stored snapshots, or one period of them, which prunes to that partition's files."""
    df = spark.read.schema(schema).parquet(path)
    return df if period_column is None else df.filter(F.col(period_column) == F.lit(period))


def attach_table(
    spark: SparkSession, table: str, path: str, schema: StructType, period_column: str
) -> DataFrame:
    """Make the snapshots below ``path`` a catalog table, or refresh its list of periods.

    Writes go through ``write_snapshot``: an insert into the table would follow the overwrite mode
    of the session.
    """
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
        f"PARTITIONED BY (`{period_column}`) LOCATION '{path}'"
    )
    spark.sql(f"MSCK REPAIR TABLE {table} SYNC PARTITIONS")
    return spark.table(table)


def upsert_snapshot(
    target: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    period_column: str | None = None,
    period: Any = None,
) -> DataFrame:
    """Rows of ``new``, and those of ``target`` whose key ``new`` lacks.

    With ``period_column`` all rows get the ``period`` that the result stands for. Kept rows would
    otherwise still have the one before, and storing them would replace that one.

    Plain Parquet tables know no MERGE: the result is a full snapshot, to be written as its own
    period with ``write_snapshot``.
    """
    kept = target.join(new.select(*keys).distinct(), list(keys), "left_anti")
    merged = kept.select(*new.columns).unionByName(new)
    if period_column is None:
        return merged
    kind = new.schema[period_column].dataType
    return merged.withColumn(period_column, F.lit(period).cast(kind)).select(*new.columns)


def fold_periods(
    spark: SparkSession,
    path: str,
    schema: StructType,
    period_column: str,
    periods: Iterable[Any],
    step: Callable[[DataFrame, Any], DataFrame],
) -> DataFrame:
    """Run ``step(previous snapshots, period)`` for each period and store every result.

    Each step reads what the one before has written, so the plan does not grow with the number of
    periods. The loop goes on from what is stored: a period that has been stored is built anew from
    those before it. Whole-number periods must follow each other, so a gap is refused.
    """
    store, place = _folder(spark, path)
    begun = store.exists(place) and bool(store.globStatus(_folder(spark, f"{path}/{period_column}=*")[1]))
    stored = read_snapshot(spark, path, schema) if begun else spark.createDataFrame([], schema)
    for period in periods:
        if isinstance(period, int):
            earlier = stored.filter(F.col(period_column) < period).agg(F.max(period_column)).first()[0]
            if earlier is not None and earlier != period - 1:
                raise ValueError(f"period {period - 1} is not stored, but {earlier} is")
        write_snapshot(step(stored, period), path, period_column, period=period)
        stored = read_snapshot(spark, path, schema)
    return stored
