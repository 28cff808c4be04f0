import datetime as dt
import random
from itertools import groupby

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidemark.operators.sequences import rolling_count_max, streaks, team_games

START = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def played(spark):
    """(team, day, game, won, pts): team 0 has half the rows, one team is NULL, some days are."""
    rng = random.Random(13)
    data = []
    for game in range(600):
        team = 0 if game % 2 else rng.choice([1, 2, 3, None])
        day = None if rng.random() < 0.03 else START + dt.timedelta(days=rng.randrange(60))
        pts = rng.choice([None, 5.0, 10.0, 11.0, 30.0, 30.0])
        data.append((team, day, game, rng.random() < 0.6, pts))
    frame = spark.createDataFrame(data, "team int, day date, game int, won boolean, pts double")
    return data, frame.cache()


def ordered(data):
    def place(row):
        return (str(row[0]), row[1] is None, row[1] or START, row[2])

    return groupby(sorted(data, key=place), key=lambda row: row[0])


@pytest.mark.parametrize("n", [1, 7, 90])
@pytest.mark.parametrize("max_rows", [10, 37, 10_000])
def test_rolling_count(played, n, max_rows):
    data, frame = played
    expected = []
    for team, group in ordered(data):
        won = [row[3] for row in group]
        best = max(sum(won[max(0, i - n + 1) : i + 1]) for i in range(len(won)))
        expected.append((team, best))
    found = rolling_count_max(frame, "team", ["day", "game"], "won", n, max_rows)
    assert rows(found) == sorted(expected, key=repr)


@pytest.mark.parametrize("min_len", [1, 2, 4])
@pytest.mark.parametrize("max_rows", [10, 37, 10_000])
def test_streaks(played, min_len, max_rows):
    data, frame = played
    expected = []
    for team, group in ordered(data):
        for met, run in groupby(group, key=lambda row: row[4] is not None and row[4] > 10):
            run = list(run)
            if met and len(run) >= min_len:
                expected.append((team, run[0][1], run[-1][1], len(run)))
    found = streaks(frame, "team", ["day", "game"], F.col("pts") > 10, min_len, max_rows)
    assert rows(found) == sorted(expected, key=repr)


def test_streaks_misses_and_singles_add_up(played):
    data, frame = played
    found = streaks(frame, "team", ["day", "game"], F.col("pts") > 10, 1, 20)
    in_streaks = found.agg(F.sum("streak_length")).first()[0]
    misses = frame.filter("pts IS NULL OR pts <= 10").count()
    assert in_streaks + misses == len(data)


def test_team_games_of_both_sides(spark):
    games = spark.createDataFrame(
        [(1, START, 10, 1), (2, START, 20, 0)],
        "game_id int, game_date_est date, home_team_id int, home_team_wins int",
    )
    details = spark.createDataFrame(
        [(1, 10), (1, 10), (1, 20), (2, 10), (2, 20)], "game_id int, team_id int"
    )
    assert rows(team_games(games), "team_id", "game_id", "won") == [(10, 1, True), (20, 2, False)]
    assert rows(team_games(games, details), "team_id", "game_id", "won") == [
        (10, 1, True), (10, 2, True), (20, 1, False), (20, 2, False)
    ]
