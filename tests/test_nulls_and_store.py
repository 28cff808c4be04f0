"""NULL keys, resumed folds, empty reruns, upserts into the store, shifted CSV headers."""

import pytest
from helpers import rows

from tidemark.operators import cumulative, scd
from tidemark.plans.session import AUTO_BROADCAST, set_join_policy
from tidemark.sources.files import read_csv
from tidemark.sources.snapshots import fold_periods, read_snapshot, upsert_snapshot, write_snapshot

STATES = "actorid long, quality_class string, is_active boolean, current_year int"
SCHEMA = "k string, n int, period int"


def test_null_keys_have_no_history(spark):
    data = [(1, "good", True, 2000), (1, "bad", True, 2001), (None, "bad", True, 2000), (None, "bad", True, 2001)]
    states = spark.createDataFrame(data, STATES)
    whole = scd.scd2_backfill(states, 2001)
    step = scd.scd2_step(scd.scd2_backfill(states, 2000), states, 2001)
    assert rows(whole) == rows(step) == [(1, "bad", True, 2001, 2001, 2001), (1, "good", True, 2000, 2000, 2001)]


def test_null_key_of_a_stored_history_is_left_out(spark):
    stored = spark.createDataFrame([(None, "bad", True, 2000, 2000, 2000)], "actorid long, quality_class string, is_active boolean, start_year int, end_year int, current_year int")
    current = spark.createDataFrame([(None, "bad", True, 2001), (2, "good", None, 2001)], STATES)
    assert rows(scd.scd2_step(stored, current, 2001)) == [(2, "good", None, 2001, 2001, 2001)]


def test_null_keys_are_no_entities(spark):
    table = cumulative.ACTORS
    data = [(None, "x", 2000, "f1", 5, 8.0), (7, "y", 2000, "f2", 5, 8.0)]
    names = [table.key, table.label, table.period, table.item_id, "votes", table.measure]
    films = spark.createDataFrame(data, ", ".join(f"{n} {k}" for n, k in zip(names, ("long", "string", "int", "string", "int", "double"), strict=True)))
    if not {"film", "filmid"} & set(films.columns):
        pytest.skip("items need other columns")
    found = cumulative.entity_history(films.withColumnRenamed("votes", "film"), 2000, with_items=False)
    assert [r[table.key] for r in found.collect()] == [7]


def add(spark):
    def step(stored, period):
        before = stored.filter(f"period = {period - 1}").selectExpr("k", "n + 1 AS n")
        fresh = spark.createDataFrame([(f"new{period}", 0)], "k string, n int")
        return before.union(fresh).selectExpr("k", "n", f"{period} AS period")

    return step


def test_fold_in_two_parts(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    whole = fold_periods(spark, str(tmp_path / "a"), schema, "period", [1, 2, 3], add(spark))
    fold_periods(spark, str(tmp_path / "b"), schema, "period", [1, 2], add(spark))
    cut = fold_periods(spark, str(tmp_path / "b"), schema, "period", [3], add(spark))
    assert rows(whole) == rows(cut) and whole.count() == 6
    with pytest.raises(ValueError):
        fold_periods(spark, str(tmp_path / "b"), schema, "period", [5], add(spark))


def test_empty_rerun_clears_its_period(spark, tmp_path):
    path = str(tmp_path / "s")
    full = spark.createDataFrame([("a", 1, 1), ("b", 1, 2)], SCHEMA)
    write_snapshot(full, path, "period")
    write_snapshot(full.filter("n > 5"), path, "period", period=2)
    assert rows(read_snapshot(spark, path, full.schema)) == [("a", 1, 1)]


def test_stored_upsert_keeps_the_day_before(spark, tmp_path):
    path = str(tmp_path / "s")
    first = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], SCHEMA)
    write_snapshot(first, path, "period")
    stored = read_snapshot(spark, path, first.schema, "period", 1)
    second = upsert_snapshot(stored, spark.createDataFrame([("a", 2, 2)], SCHEMA), ["k"], "period", 2)
    write_snapshot(second, path, "period", period=2)
    assert rows(read_snapshot(spark, path, first.schema)) == [("a", 1, 1), ("a", 2, 2), ("b", 1, 1), ("b", 1, 2)]


def test_shifted_header_is_an_error(spark, tmp_path):
    file = tmp_path / "m.csv"
    file.write_text("name,medal_id\nGold,1\n")
    schema = spark.createDataFrame([], "medal_id long, name string").schema
    with pytest.raises(Exception, match="(?i)header|FAILFAST|CSV"):
        read_csv(spark, str(file), schema).collect()
    right = spark.createDataFrame([], "name string, medal_id long").schema
    assert rows(read_csv(spark, str(file), right)) == [("Gold", 1)]


def test_join_policy_keeps_a_threshold(spark):
    own = spark.newSession()
    own.conf.set(AUTO_BROADCAST, "104857600b")
    assert set_join_policy(own, True).conf.get(AUTO_BROADCAST) == "104857600b"
    set_join_policy(own, False)
    assert set_join_policy(own, True).conf.get(AUTO_BROADCAST) == "10485760b"
