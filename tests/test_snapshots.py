import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.plans.session import shared_dir
from tidemark.sources.snapshots import attach_table, read_snapshot, write_snapshot

SCHEMA = schemas.PLAYER_STATES


def season(spark, year, *names):
    return spark.createDataFrame([(n, "New", year) for n in names], SCHEMA)


@pytest.mark.parametrize("mode", ["static", "dynamic"])
def test_rerun_replaces_its_period_only(spark, mode):
    path = shared_dir(spark, "store")
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    try:
        write_snapshot(season(spark, 2000, "a", "b"), path, "season")
        for names in (["a"], ["a", "c"]):
            stored = read_snapshot(spark, path, SCHEMA, "season", 2000)
            step = stored.select("player_name", "status", F.lit(2001).alias("season")).unionByName(
                season(spark, 2001, *names)
            )
            write_snapshot(step, path, "season")
        found = read_snapshot(spark, path, SCHEMA)
        assert rows(found, "player_name", "season") == sorted(
            [("a", 2000), ("b", 2000), ("a", 2001), ("b", 2001), ("a", 2001), ("c", 2001)], key=repr
        )
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def test_one_period_is_read_from_its_partition(spark):
    path = shared_dir(spark, "store")
    write_snapshot(season(spark, 2000, "a").unionByName(season(spark, 2001, "b")), path, "season")
    one = read_snapshot(spark, path, SCHEMA, "season", 2001)
    assert rows(one, "player_name") == [("b",)]
    assert "PartitionFilters: [isnotnull(season" in plan(one)


def test_catalog_table_follows_the_store(spark):
    path = shared_dir(spark, "store")
    write_snapshot(season(spark, 2000, "a"), path, "season")
    table = attach_table(spark, "player_states_test", path, SCHEMA, "season")
    assert rows(table, "player_name", "season") == [("a", 2000)]
    write_snapshot(season(spark, 2001, "b"), path, "season")
    table = attach_table(spark, "player_states_test", path, SCHEMA, "season")
    assert rows(table, "player_name", "season") == [("a", 2000), ("b", 2001)]
    assert rows(spark.sql("SELECT max(season) FROM player_states_test")) == [(2001,)]
