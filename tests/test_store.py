"""Versions, snapshot stores and keyed tables: what is read, what is written, what survives a failure."""

import datetime as dt
import re

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import cumulative, datelist, lifecycle, scd
from tidemark.plans.session import shared_dir
from tidemark.queries import QUERIES
from tidemark.sources.store import KeyedTable, SnapshotStore
from tidemark.sources.versions import ConcurrentWrite, VersionLog, bucket_of

SCHEMA = "k string, n int, period int"


@pytest.fixture
def store(spark):
    schema = spark.createDataFrame([], SCHEMA).schema
    return SnapshotStore(spark, shared_dir(spark, "store"), schema, "period", ["k"], 4)


@pytest.fixture
def keyed(spark):
    schema = spark.createDataFrame([], "k string, n int").schema
    return KeyedTable(spark, shared_dir(spark, "keyed"), schema, ["k"], 8)


def snapshot(spark, period, *pairs):
    return spark.createDataFrame([(k, n, period) for k, n in pairs], SCHEMA)


def pairs(spark, *found):
    return spark.createDataFrame(list(found), "k string, n int")


# Versions


def test_a_number_is_published_once(spark):
    log = VersionLog(spark, shared_dir(spark, "log"))
    assert log.read() == {"version": 0}
    assert log.publish(0, {"a": 1}) == 1
    with pytest.raises(ConcurrentWrite):
        log.publish(0, {"a": 2})
    assert log.read() == {"a": 1, "version": 1}
    assert log.publish(1, {"a": 3}) == 2
    assert log.read(1)["a"] == 1 and log.read()["a"] == 3
    assert sorted(n for n in log.names("log") if n.endswith(".json")) == ["0000000001.json", "0000000002.json"]


def test_bucket_of_a_file():
    assert bucket_of("part-00003-6497dda7-cc79-418d-a63f-7fe63c8257b4_00012.c000.snappy.parquet") == 12


# Snapshot store


def test_a_rewrite_leaves_other_periods_and_the_version_before(spark, store):
    store.write(snapshot(spark, 1, ("a", 1)), 1)
    store.write(snapshot(spark, 2, ("a", 2), ("b", 0)), 2)
    assert store.write(snapshot(spark, 2, ("c", 5)), 2) == 1
    assert rows(store.read_all()) == [("a", 1, 1), ("c", 5, 2)]
    assert rows(store.read(2, version=2)) == [("a", 2, 2), ("b", 0, 2)]
    assert rows(store.read(3)) == []


def test_a_frame_keeps_the_version_it_was_read_from(spark, store):
    store.write(snapshot(spark, 1, ("a", 1)), 1)
    before = store.read(1)
    store.write(snapshot(spark, 1, ("a", 9)), 1)
    assert rows(before) == [("a", 1, 1)] and rows(store.read(1)) == [("a", 9, 1)]


def test_a_period_is_rewritten_from_itself(spark, store):
    store.write(snapshot(spark, 1, ("a", 1), ("b", 2)), 1)
    store.write(store.read(1).withColumn("n", F.col("n") + 1), 1, clustered=True)
    assert rows(store.read(1)) == [("a", 2, 1), ("b", 3, 1)]


def test_a_failed_write_leaves_the_last_version(spark, store):
    store.write(snapshot(spark, 1, ("a", 1)), 1)
    broken = snapshot(spark, 1, ("a", 2)).withColumn("n", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        store.write(broken, 1)
    with pytest.raises(ValueError, match="not of period 2"):
        store.write(snapshot(spark, 1, ("a", 2)), 2)
    assert rows(store.read_all()) == [("a", 1, 1)] and list(store.periods()) == ["1"]


def test_a_step_runs_once(spark, store):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    store.write(snapshot(spark, 1, *((str(i), i) for i in range(100))), 1)
    store.advance(1, 2, lambda before: before.withColumn("period", F.lit(2)).mapInArrow(count, SCHEMA))
    assert seen.value == 100 and store.read(2).count() == 100


def test_only_the_new_rows_of_a_step_are_shuffled(spark, store):
    for period in (1, 2):
        store.write(snapshot(spark, period, *((str(i), i) for i in range(100))), period)
    new = spark.range(50, 150).selectExpr("cast(id as string) AS k", "1 AS m")
    text = plan(store.read(2).join(new, "k", "full"))
    assert len(re.findall(r"\bExchange\b", text)) == 1
    stored = text[text.index("FileScan") :]
    assert "Bucketed: true" in stored and "SelectedBucketsCount: 4 out of 4" in stored
    assert all("/data/2-" in name for name in store.read(2).inputFiles())
    assert text.index("FileScan") < text.index("Exchange")


def test_other_writers_periods_are_kept(spark, store, monkeypatch):
    store.write(snapshot(spark, 1, ("a", 1)), 1)
    first, other = VersionLog.publish, SnapshotStore(spark, store.log.path, store.schema, "period", ["k"])

    def late(log, after, content, done=[]):
        if not done:
            done.append(True)
            other.write(snapshot(spark, 3, ("z", 3)), 3)
        return first(log, after, content)

    monkeypatch.setattr(VersionLog, "publish", late)
    store.write(snapshot(spark, 2, ("b", 2)), 2)
    assert rows(store.read_all()) == [("a", 1, 1), ("b", 2, 2), ("z", 3, 3)]


def test_the_same_period_written_by_two_is_refused(spark, store, monkeypatch):
    first, other = VersionLog.publish, SnapshotStore(spark, store.log.path, store.schema, "period", ["k"])

    def late(log, after, content, done=[]):
        if not done:
            done.append(True)
            other.write(snapshot(spark, 2, ("z", 3)), 2)
        return first(log, after, content)

    monkeypatch.setattr(VersionLog, "publish", late)
    with pytest.raises(ConcurrentWrite):
        store.write(snapshot(spark, 2, ("b", 2)), 2)
    assert rows(store.read_all()) == [("z", 3, 2)]


def test_vacuum_keeps_what_versions_point_to(spark, store):
    for n in range(3):
        store.write(snapshot(spark, 1, ("a", n)), 1)
    assert store.vacuum(keep=2) == []  # too young
    assert len(store.vacuum(keep=2, older_than=0)) == 1
    assert rows(store.read(1, version=2)) == [("a", 1, 1)] and rows(store.read(1)) == [("a", 2, 1)]
    assert len(store.vacuum(keep=1, older_than=0)) == 1
    assert store.log.read()["version"] == 3


SEASONS = [("a", 2000), ("a", 2001), ("b", 2001), ("a", 2003), ("c", 2003), ("b", 2004), (None, 2001)]


def test_fold_in_two_runs_equals_the_closed_form(spark):
    seasons = spark.createDataFrame(SEASONS, schemas.PLAYER_SEASONS)

    def step(stored, season):
        return lifecycle.lifecycle_step(stored, seasons, season)

    def opened(path):
        return SnapshotStore(spark, path, schemas.PLAYER_STATES, "season", ["player_name"], 4)

    path = shared_dir(spark, "fold")
    opened(path).fold([2000, 2001, 2002], step)
    whole = opened(path).fold([2003, 2004], step)
    assert rows(whole) == rows(lifecycle.lifecycle_history(seasons, 2004))
    with pytest.raises(ValueError, match="2005"):
        opened(path).fold([2006], step)
    # A season in the middle is built anew from the one before it.
    assert rows(opened(path).fold([2002], step)) == rows(whole)


def test_histories_advance_without_a_shuffle(spark):
    films = spark.createDataFrame(
        [(f"a{i % 7}", f"n{i % 7}", 2000 + i % 3, f"t{i}", i, i % 10 + 0.5, f"f{i}") for i in range(60)],
        "actorid string, actor string, year int, film string, votes int, rating double, filmid string",
    )

    def opened(name, schema):
        return SnapshotStore(spark, shared_dir(spark, name), schema, "current_year", ["actorid"], 4)

    actors, histories = opened("actors", schemas.ACTORS), opened("scd", schemas.ACTORS_HISTORY_SCD)
    actors.fold([2000, 2001, 2002], lambda stored, year: cumulative.cumulate_entities(stored, films, year))
    assert rows(actors.read_all(), *schemas.ACTORS.names) == rows(cumulative.entity_history(films, 2002), *schemas.ACTORS.names)
    last = None
    for year in (2000, 2001, 2002):
        last = histories.advance(
            None if last is None else year - 1, year, lambda stored, y=year: scd.scd2_step(stored, actors.read(y), y)
        )
    states = cumulative.entity_history(films, 2002, with_items=False)
    names = schemas.ACTORS_HISTORY_SCD.names
    assert rows(last, *names) == rows(scd.scd2_backfill(states, 2002), *names)
    assert "Exchange" not in plan(scd.scd2_step(histories.read(2001), actors.read(2002), 2002))


def test_bitmaps_advance_as_the_lists_say(spark):
    first = dt.date(2024, 1, 1)
    days = spark.createDataFrame(
        [(str(i % 5), first + dt.timedelta(days=i * i % 50)) for i in range(40)], "user_id string, date_active date"
    ).distinct()
    keys, last = ["user_id"], first + dt.timedelta(days=60)
    bits = datelist.datelist_int(datelist.datelist_history(days, keys, first, first_day=first), keys, first)
    day = first
    while day < last:
        day += dt.timedelta(days=1)
        bits = spark.createDataFrame(datelist.bitmap_step(bits, days, keys, day).collect(), bits.schema)
        if day.day % 9 == 0 or day == last:
            lists = datelist.datelist_history(days, keys, day, first_day=day)
            assert rows(bits) == rows(datelist.datelist_int(lists, keys, day))


# Keyed table


def test_an_update_rewrites_changed_buckets_only(spark, keyed):
    keyed.upsert(pairs(spark, *((str(i), 0) for i in range(200))))
    before = keyed.files()
    assert len(before) == 8
    keyed.upsert(pairs(spark, ("7", 1), ("new", 2)))
    after = keyed.files()
    changed = {b for b in after if after[b] != before.get(b)}
    cells = spark.createDataFrame([("7",), ("new",)], "k string").select(F.pmod(F.hash("k"), F.lit(8))).collect()
    assert changed == {str(r[0]) for r in cells}
    assert keyed.read().count() == 201
    assert rows(keyed.read().filter("n > 0")) == [("7", 1), ("new", 2)]
    assert rows(keyed.read(1).filter("k = '7'")) == [("7", 0)] and keyed.read(1).count() == 200


def test_null_is_a_key(spark, keyed):
    keyed.upsert(pairs(spark, (None, 1), ("a", 1)))
    keyed.upsert(pairs(spark, (None, 2)))
    assert rows(keyed.read()) == [("a", 1), (None, 2)]
    keyed.upsert(pairs(spark).limit(0))
    assert keyed.read().count() == 2


def test_a_repeated_batch_changes_nothing(spark, keyed):
    keyed.upsert(pairs(spark, ("a", 1)), ("stream", 0))
    version = keyed.upsert(pairs(spark, ("a", 2), ("b", 1)), ("stream", 1))
    assert keyed.upsert(pairs(spark, ("a", 99)), ("stream", 1)) == version
    assert keyed.upsert(pairs(spark, ("a", 99)), ("stream", 0)) == version
    assert rows(keyed.read()) == [("a", 2), ("b", 1)]
    keyed.upsert(pairs(spark, ("b", 7)), ("other", 0))  # another writer counts apart
    assert rows(keyed.read()) == [("a", 2), ("b", 7)]


def test_values_are_added(spark, keyed):
    keyed.upsert(pairs(spark, ("a", 1), (None, 5)), add=True)
    keyed.upsert(pairs(spark, ("a", 2), ("b", 4), (None, 1)), ("s", 0), add=True)
    keyed.upsert(pairs(spark, ("a", 2)), ("s", 0), add=True)
    assert rows(keyed.read()) == sorted([("a", 3), ("b", 4), (None, 6)], key=repr)


def test_a_crash_half_way_is_as_if_nothing_was_written(spark, keyed, monkeypatch):
    keyed.upsert(pairs(spark, ("a", 1)), ("stream", 0))
    with monkeypatch.context() as broken:
        broken.setattr(VersionLog, "publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            keyed.upsert(pairs(spark, ("a", 2)), ("stream", 1))
    assert rows(keyed.read()) == [("a", 1)]
    keyed.upsert(pairs(spark, ("a", 2)), ("stream", 1))
    assert rows(keyed.read()) == [("a", 2)]
    assert len(keyed.vacuum(keep=1, older_than=0)) >= 2 and rows(keyed.read()) == [("a", 2)]


def test_an_update_meets_that_of_another_writer(spark, keyed, monkeypatch):
    keyed.upsert(pairs(spark, ("a", 1), ("b", 1)))
    first, other = VersionLog.publish, KeyedTable(spark, keyed.log.path, keyed.schema, ["k"])

    def late(log, after, content, done=[]):
        if not done:
            done.append(True)
            other.upsert(pairs(spark, ("b", 2), ("c", 2)))
        return first(log, after, content)

    monkeypatch.setattr(VersionLog, "publish", late)
    keyed.upsert(pairs(spark, ("a", 3)))
    assert rows(keyed.read()) == [("a", 3), ("b", 2), ("c", 2)]


# The queries


@pytest.mark.parametrize("name", ["entity_snapshot_step", "scd_step", "user_datelist_step", "monthly_reduced_step", "lifecycle_step"])
def test_steps_read_one_stored_period(spark, name):
    """A later call finds the store, and reads what it has written from the folder of one period."""
    folder = "/root/testdata/sf0.001"
    first, second = (rows(QUERIES[name](spark, folder)) for _ in range(2))
    assert first == second
    text = plan(QUERIES[name](spark, folder))
    assert "Bucketed" in text and "orders.parquet" not in text and "events.parquet" not in text


def test_rows_that_are_known_to_be_none(spark, store):
    """Adaptive execution drops an empty frame, and with it what counts its rows."""
    store.write(snapshot(spark, 1, ("a", 1)), 1)
    for none in (snapshot(spark, 1, ("a", 1)).filter("n > 5"), store.read(1).filter("false"), store.read(1).limit(0)):
        assert store.write(none, 1) == 0 and rows(store.read(1)) == []
        store.write(snapshot(spark, 1, ("a", 1)), 1)
    assert store.write(store.read(1).filter("n > 5"), 1) == 0
