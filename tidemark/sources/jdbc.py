"""JDBC tables. Connection options and the driver class are passed through to Spark."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def read_jdbc(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    """A bounded read. Give ``partitionColumn``, bounds and ``numPartitions`` for a parallel one."""
    return spark.read.format("jdbc").options(**options).load()


def write_jdbc(df: DataFrame, options: Mapping[str, str], mode: str = "append") -> None:
    """Write the rows; one connection per partition of ``df``."""
    df.write.format("jdbc").options(**options).mode(mode).save()
