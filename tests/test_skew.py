import random

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from tidemark.plans import skew
from tidemark.plans.ordered import CHUNK, collapse_runs, cut_hot_keys, with_position


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(17)
    data = [(None if n % 3 == 0 else rng.randrange(5), rng.randrange(1000), n) for n in range(900)]
    return spark.createDataFrame(data, "k int, at int, id int").cache()


def test_hot_keys_include_null(skewed):
    hot = skew.find_hot_keys(skewed, ["k"], 200)
    assert [(r.k, r.hot_n) for r in hot.table.collect()] == [(None, 300)]
    assert skew.find_hot_keys(skewed, ["k"], 300) is None
    marked = hot.mark(skewed)
    assert marked.filter("k IS NULL AND hot_n = 300").count() == 300
    assert marked.filter("hot_n IS NULL").count() == 600
    assert marked.count() == 900


def test_many_hot_keys_stay_distributed(skewed, monkeypatch):
    monkeypatch.setattr(skew, "MAX_LOCAL_KEYS", 2)
    hot = skew.find_hot_keys(skewed, ["k"], 10)
    assert not hot.local
    assert hot.mark(skewed).filter("hot_n IS NOT NULL").count() == 900


def test_chunks_follow_the_order(skewed):
    cut, needed = cut_hot_keys(skewed, ["k"], ["at", "id"], 50)
    assert needed
    assert rows(cut.drop(CHUNK)) == rows(skewed)
    place = F.struct("at", "id")
    bounds = cut.groupBy("k", CHUNK).agg(F.min(place).alias("low"), F.max(place).alias("high"))
    chunks = sorted((repr(r.k), r[CHUNK], r.low, r.high) for r in bounds.collect())
    for one, other in zip(chunks, chunks[1:]):
        assert one[0] != other[0] or one[3] < other[2]
    assert max(r["count"] for r in cut.groupBy("k", CHUNK).count().collect()) <= 50


def test_uneven_keys_are_cut_evenly(spark):
    """Most rows of the key lie in a hundredth of its range."""
    df = spark.range(20_000).select(
        F.lit(1).alias("k"),
        F.when(F.col("id") % 10 > 0, F.col("id") * 0.01).otherwise(F.col("id") * 1.0).alias("at"),
        "id",
    )
    cut, _ = cut_hot_keys(df, ["k"], ["at", "id"], 1000)
    sizes = [r["count"] for r in cut.groupBy(CHUNK).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 1000
    spans = cut.groupBy(CHUNK).agg(F.min("at").alias("low"), F.max("at").alias("high"))
    found = sorted((r[CHUNK], r.low, r.high) for r in spans.collect())
    assert all(one[2] < other[1] for one, other in zip(found, found[1:]))


@pytest.mark.parametrize("local", [True, False])
def test_one_value_for_all_rows_is_cut_by_the_rest_of_the_order(spark, monkeypatch, local):
    """Text, NULLs and a first column without any difference: no chunk is over the bound."""
    if not local:
        monkeypatch.setattr(skew, "MAX_LOCAL_KEYS", 0)
    df = spark.range(3000).select(
        F.lit("k").alias("k"),
        F.when(F.col("id") % 3 > 0, F.lit("same")).alias("day"),
        F.when(F.col("id") % 2 > 0, F.concat(F.lit("g"), F.col("id") % 5)).alias("game"),
        "id",
    )
    cut, needed = cut_hot_keys(df, ["k"], ["day", "game"], 200)
    assert needed and rows(cut.drop(CHUNK)) == rows(df)
    found = [(r[CHUNK], r["day"] is None, r["game"] is None, r["game"] or "") for r in cut.collect()]
    sizes = {c: sum(f[0] == c for f in found) for c in {f[0] for f in found}}
    assert max(sizes.values()) <= 200
    found.sort(key=lambda f: f[1:])  # by the order, NULLs last: chunk numbers must not fall
    last = {}
    for f in found:
        last.setdefault(f[1:], []).append(f[0])
    spans = [(min(c), max(c)) for _, c in sorted(last.items())]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_keys_that_share_a_cell_are_told_apart(skewed):
    for cells in (1, 2, 1 << 20):
        hot = skew.find_hot_keys(skewed, ["k"], 200, cells)
        assert [(r.k, r.hot_n) for r in hot.table.collect()] == [(None, 300)]
        assert skew.find_hot_keys(skewed, ["k"], 300, cells) is None


def test_distributed_list_is_cut_by_range(spark, skewed, monkeypatch):
    monkeypatch.setattr(skew, "MAX_LOCAL_KEYS", 0)
    cut, needed = cut_hot_keys(skewed, ["k"], ["at", "id"], 50)
    assert needed and rows(cut.drop(CHUNK)) == rows(skewed)
    assert cut.select("k", CHUNK).distinct().count() > 20


def test_position_counts_through_chunks(skewed):
    cut, _ = cut_hot_keys(skewed, ["k"], ["at", "id"], 50)
    found = with_position(cut, ["k"], ["at", "id"])
    expected, seen = [], {}
    for row in sorted(skewed.collect(), key=lambda r: (r.at, r.id)):
        seen[row.k] = seen.get(row.k, 0) + 1
        expected.append((row.k, row.id, seen[row.k]))
    assert rows(found, "k", "id", "position") == sorted(expected, key=repr)


@pytest.mark.parametrize("max_rows", [5, 25, 100, 10_000])
def test_runs_cross_chunk_borders(skewed, max_rows):
    def same_tenth(before, now):
        return F.floor(before("at") / 100) != F.floor(now("at") / 100)

    found = collapse_runs(
        skewed, ["k"], ["at", "id"], ["at", "id"], same_tenth, max_rows=max_rows
    )
    expected = skewed.groupBy("k", F.floor(F.col("at") / 100)).agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n_rows")
    )
    columns = ("k", "first_at", "last_at", "n_rows")
    assert rows(found, *columns) == rows(expected, *columns)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_keeps_every_pair(spark, how):
    left = spark.createDataFrame(
        [(1 if n % 3 else n, n) for n in range(120)] + [(None, -1), (7, -2), (7, -2), (8, 1), (9, 5)],
        "k int, a int",
    )
    right = spark.createDataFrame(
        [(1, n) for n in range(35)] + [(6, 9), (None, 3)] + [(8, n) for n in range(30)], "k int, b int"
    )
    expected = rows(left.join(right, "k", how))
    hot_left, hot_right = (skew.find_hot_keys(df, ["k"], 10) for df in (left, right))
    assert hot_left and hot_right
    for lists in ((None, None), (hot_left, None), (None, hot_right), (hot_left, hot_right)):
        assert rows(skew.salted_join(left, right, "k", how, *lists)) == expected
    with pytest.raises(ValueError):
        skew.salted_join(left, right, "k", "full", hot_left)


def test_rows_bound(skewed):
    assert skew.rows_bound(skewed, ["k"], 200) == 200
    assert skew.rows_bound(skewed, ["k"], 300) is None


def test_size_check(spark):
    df = spark.range(100).withColumn("text", F.repeat(F.lit("x"), 100))
    assert skew.is_small(df)
    assert not skew.is_small(df, max_rows=99)
    assert not skew.is_small(df, max_bytes=10_000)
    assert skew.is_small(df.withColumn("many", F.array("text")))
    assert skew.is_small(df.limit(0))
