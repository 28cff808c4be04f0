import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators.profile import key_violations
from tidemark.operators.scd import scd2_backfill, scd2_step
from tidemark.plans.session import shared_dir
from tidemark.sources.snapshots import fold_periods

STATES = "actorid string, quality_class string, is_active boolean, current_year int"
COLUMNS = ("actorid", "quality_class", "is_active", "start_year", "end_year", "current_year")


def test_one_year_each(spark):
    df = spark.createDataFrame(
        [("11", "Good", True, 2024), ("22", "Good", False, 2024), ("33", "Bad", True, 2024),
         ("44", "Bad", False, 2024)],
        STATES,
    )
    assert rows(scd2_backfill(df, 2024), *COLUMNS) == [
        ("11", "Good", True, 2024, 2024, 2024), ("22", "Good", False, 2024, 2024, 2024),
        ("33", "Bad", True, 2024, 2024, 2024), ("44", "Bad", False, 2024, 2024, 2024),
    ]


def test_null_attributes(spark):
    classes = ["good", None, None, "good", "good"]
    df = spark.createDataFrame([("a", c, True, 2000 + i) for i, c in enumerate(classes)], STATES)
    assert rows(scd2_backfill(df, 2004), "quality_class", "start_year", "end_year") == [
        ("good", 2000, 2000), ("good", 2003, 2004), (None, 2001, 2002)
    ]
    assert rows(scd2_backfill(df, 2001), "quality_class", "end_year") == [("good", 2000), (None, 2001)]


def test_step_cases(spark):
    scd = spark.createDataFrame(
        [("same", "good", True, 1988, 1991, 1991), ("changed", "good", True, 1990, 1991, 1991),
         ("changed", "bad", True, 1988, 1989, 1991), ("gone", "good", True, 1990, 1991, 1991),
         ("null", None, True, 1990, 1991, 1991), ("other", "good", True, 1980, 1980, 1985)],
        "actorid string, quality_class string, is_active boolean, start_year int, end_year int, "
        "current_year int",
    )
    now = spark.createDataFrame(
        [("same", "good", True, 1992), ("changed", "star", True, 1992), ("new", "bad", True, 1992),
         ("null", None, True, 1992)],
        STATES,
    )
    kept = [
        ("changed", "bad", True, 1988, 1989, 1992), ("changed", "good", True, 1990, 1991, 1992),
        ("changed", "star", True, 1992, 1992, 1992), ("gone", "good", True, 1990, 1991, 1992),
        ("new", "bad", True, 1992, 1992, 1992), ("null", None, True, 1990, 1992, 1992),
        ("same", "good", True, 1988, 1992, 1992),
    ]
    assert rows(scd2_step(scd, now, 1992), *COLUMNS) == kept
    dropped = [row for row in kept if row[0] != "gone"]
    assert rows(scd2_step(scd, now, 1992, drop_missing=True), *COLUMNS) == dropped


@pytest.fixture(scope="module")
def states(spark):
    rng = random.Random(3)
    data = []
    for actor in range(25):
        for year in range(rng.randrange(1990, 1996), 2001):
            data.append((f"a{actor}", rng.choice(["good", "bad", None]), rng.random() < 0.7, year))
    return spark.createDataFrame(data, STATES).cache()


def test_fold_equals_backfill(spark, states):
    folded = fold_periods(
        spark, shared_dir(spark, "scd"), schemas.ACTORS_HISTORY_SCD, "current_year",
        range(1990, 2001), lambda stored, year: scd2_step(stored, states, year),
    )
    whole = scd2_backfill(states, 2000)
    assert rows(folded.filter("current_year = 2000"), *COLUMNS) == rows(whole, *COLUMNS)


def test_intervals_cover_every_year_once(states):
    scd = scd2_backfill(states, 2000)
    years = scd.select(
        "actorid", "quality_class", "is_active",
        F.explode(F.sequence("start_year", "end_year")).alias("current_year"),
    )
    assert rows(years) == rows(states, *years.columns)
    assert key_violations(scd, ["actorid", "start_year"]).isEmpty()


def test_cut_keys_give_the_same_intervals(states):
    for max_rows in (1, 2, 3, 5):
        assert rows(scd2_backfill(states, 2000, max_rows=max_rows)) == rows(scd2_backfill(states, 2000))
