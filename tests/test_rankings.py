from helpers import rows
from pyspark.sql import functions as F

from tidemark.operators import rankings

DETAILS = [(1, "a", 10), (1, "b", 4), (2, "a", 2), (3, "b", 8), (3, "c", 6), (4, None, 99)]
MEDALS = [(1, 7), (1, 7), (1, 8), (2, 7), (3, 8), (4, 7), (9, 7)]


def frames(spark):
    details = spark.createDataFrame(DETAILS, "match_id int, player string, kills int")
    medals = spark.createDataFrame(MEDALS, "match_id int, medal_id int").withColumn("count", F.lit(2))
    matches = spark.createDataFrame(
        [(1, "p", "m1"), (2, "p", None), (3, "q", "m2"), (4, "q", "m1"), (5, "q", "m2")],
        "match_id int, playlist string, map string",
    )
    return details, medals, matches


def test_average_and_ties(spark):
    details, medals, _ = frames(spark)
    averages = rankings.average_per_event(details, "player", "kills", "match_id")
    assert rows(averages) == [("a", 2, 12, 6.0), ("b", 2, 12, 6.0), ("c", 1, 6, 6.0)]
    assert rows(rankings.top_average(details, "player", "kills", "match_id"), "player") == [("a",)]


def test_joined_grain_equals_the_join(spark):
    details, medals, _ = frames(spark)
    joined = medals.select("match_id").join(details, "match_id").filter("player IS NOT NULL")
    expected = joined.groupBy("player").agg(
        F.count("match_id").alias("num_events"), F.sum("kills").alias("total")
    )
    found = rankings.average_per_event(details, "player", "kills", "match_id", medals)
    assert rows(found, "player", "num_events", "total") == rows(expected)


def test_most_frequent(spark):
    details, medals, matches = frames(spark)
    played = rankings.played_matches(matches, details, medals)
    assert rows(played, "match_id") == [(1,), (2,), (3,), (4,)]
    assert rows(rankings.most_frequent(played, "playlist", "match_id")) == [("p", 2)]
    assert rows(rankings.most_frequent(played, "map", "match_id")) == [("m1", 2)]
    rest = played.filter("match_id = 2")
    assert rows(rankings.most_frequent(rest, "map", "match_id")) == []
    assert rows(rankings.most_frequent(rest, "map", "match_id", keep_null_group=True)) == [(None, 1)]


def test_group_for_medal_name(spark):
    details, medals, matches = frames(spark)
    dim = spark.createDataFrame([(7, "Spree"), (8, "Other"), (9, "Spree")], "medal_id int, name string")
    found = rankings.top_group_for_lookup(
        rankings.medal_rows(medals, matches), dim, "Spree", "map", "count"
    )
    assert rows(found) == [("m1", 6)]
    joined = rankings.medal_rows(medals, matches, details)
    # Match 1 has two detail rows, match 4 one.
    assert rows(rankings.top_group_for_lookup(joined, dim, "Spree", "map", "count")) == [("m1", 10)]
    none = rankings.top_group_for_lookup(joined, dim, "Missing", "map", "count")
    assert none.isEmpty()
