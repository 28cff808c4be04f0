import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from tidemark.operators.dedup import dedup_dimension, dedup_facts, first_per_key
from tidemark.operators.profile import key_violations, profile


def test_facts_one_row_per_key(spark):
    details = spark.createDataFrame(
        [(1, 10, 100, "b"), (1, 10, 100, "a"), (1, 10, 101, "c"), (2, 10, 100, "d"), (9, 1, 1, "x")],
        "game_id int, team_id int, player_id int, note string",
    )
    games = spark.createDataFrame(
        [(1, "2020-01-01", 2020, 10), (1, "2020-01-01", 2020, 10), (2, "2020-01-02", 2020, 11)],
        "game_id int, game_date_est string, season int, home_team_id int",
    )
    found = dedup_facts(details, games, ["note"])
    assert rows(found, "game_id", "team_id", "player_id", "note", "home_team_id") == [
        (1, 10, 100, "a", 10), (1, 10, 101, "c", 10), (2, 10, 100, "d", 11)
    ]
    assert key_violations(found, ["game_id", "team_id", "player_id"]).isEmpty()


def test_dimension_keeps_devices_with_two_systems(spark):
    devices = spark.createDataFrame(
        [(7, "Chrome", "phone", "A", 2), (7, "Chrome", "phone", "A", 1), (7, "Chrome", "phone", "B", 3),
         (7, "Chrome", "phone", None, 4), (7, "Chrome", "phone", None, 5)],
        "device_id long, browser_type string, device_type string, os_type string, v int",
    )
    found = dedup_dimension(devices, ["v"])
    assert rows(found, "device_id", "os_type", "v") == [("7", "A", 1), ("7", "B", 3), ("7", None, 4)]


def test_order_is_required(spark):
    with pytest.raises(ValueError):
        first_per_key(spark.range(3), ["id"], [])


def test_copies_of_a_key_are_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    text = plan(first_per_key(df, ["k"], ["id"]))
    exchange = text.index("Exchange")
    assert text.index("WindowGroupLimit") < exchange < text.rindex("WindowGroupLimit")


def test_profile(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "a"), (None, "a")], "x int, y string")
    assert rows(profile(df, ["x", "y"])) == [(4, 3, 2, 2, 3, 1, "a")]
    assert rows(profile(df, ["y"], where=F.col("x") == 1)) == [(2, 1, 1, "a")]
    assert rows(profile(df, ["x"], by=["y"])) == [("a", 3, 2, 2, 2), (None, 1, 1, 1, 1)]
    assert rows(key_violations(df, ["y"])) == [("a", 3)]
