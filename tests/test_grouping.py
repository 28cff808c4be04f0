import random
import re

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from tidemark.operators.grouping import (
    PLAYER_SEASON,
    PLAYER_TEAM,
    TEAM,
    grouping_rollup,
    one_grouping,
    top_of_grouping,
)

DETAILS = "game_id int, team_id int, player_id int, pts double"
GAMES = "game_id int, season int, home_team_id int, home_team_wins int"


def test_rollup_and_leaders(spark):
    details = spark.createDataFrame(
        [(1, 10, 100, 20.0), (1, 10, 101, 5.0), (1, 20, 200, 9.0), (2, 10, 100, 1.0),
         (2, 20, 200, 30.0), (3, 20, 100, None), (9, 10, 100, 2.0)],
        DETAILS,
    )
    games = spark.createDataFrame(
        [(1, 2000, 10, 1), (2, 2001, 10, 0), (3, 2001, 20, 1)], GAMES
    )
    rollup = grouping_rollup(details, games)
    teams = rollup.filter(F.col("gid") == TEAM)
    # Team 10 won game 1 at home, team 20 won game 2 away and game 3 at home.
    assert rows(teams, "team_id", "total_points", "total_wins", "home_win_rows") == [
        (10, 28.0, 1, 2), (20, 39.0, 2, 2)
    ]
    seasons = rollup.filter(F.col("gid") == PLAYER_SEASON)
    # The game without an entry has a genuine NULL season.
    assert rows(seasons, "player_id", "season", "total_points") == sorted(
        [(100, 2000, 20.0), (100, 2001, 1.0), (100, None, 2.0), (101, 2000, 5.0),
         (200, 2000, 9.0), (200, 2001, 30.0)], key=repr,
    )
    best = top_of_grouping(rollup, PLAYER_TEAM, "total_points", ["player_id", "team_id"])
    assert rows(best, "player_id", "team_id", "total_points") == [(200, 20, 39.0)]
    best = top_of_grouping(rollup, PLAYER_SEASON, "total_points", ["player_id", "season"])
    assert rows(best, "player_id", "season") == [(200, 2001)]
    best = top_of_grouping(rollup, TEAM, "total_wins", ["team_id"])
    assert rows(best, "team_id", "total_wins") == [(20, 2)]


def test_ties_go_to_the_smallest_key(spark):
    details = spark.createDataFrame([(1, t, 1, 5.0) for t in (3, 1, 2)], DETAILS)
    games = spark.createDataFrame([(1, 2000, 9, 0)], GAMES)
    best = top_of_grouping(grouping_rollup(details, games), TEAM, "total_points", ["team_id"], k=2)
    assert rows(best, "team_id") == [(1,), (2,)]


@pytest.fixture(scope="module")
def season(spark):
    """Games with several rows of a player, rows without team, player, points or game."""
    draw = random.Random(5)
    games = [(g, draw.choice([2000, 2001, None]), draw.choice([1, 2, 3, None]), draw.choice([0, 1, None])) for g in range(40)]
    details = [
        (draw.randrange(45), draw.choice([1, 2, 3, 4, None]), draw.choice([7, 8, 9, None]), draw.choice([1.0, 2.5, None]))
        for _ in range(600)
    ]
    return details, games, spark.createDataFrame(details, DETAILS), spark.createDataFrame(games, GAMES)


def test_rollup_counts_each_won_game_once(season):
    details, games, df, gf = season
    by_game = {g[0]: g[1:] for g in games}
    want = {}
    for game, team, player, pts in details:
        year, home, won = by_game.get(game, (None, None, None))
        win = None if None in (team, home, won) else (team == home) == (won == 1)
        for gid, key in ((PLAYER_TEAM, (player, team, None)), (PLAYER_SEASON, (player, None, year)), (TEAM, (None, team, None))):
            group = want.setdefault((gid, *key), [0.0, set(), 0])
            group[0] += pts or 0.0
            group[1] |= {(game, team)} if win else set()
            group[2] += won or 0
    expected = sorted(((*k[1:], k[0], p, len(w), h) for k, (p, w, h) in want.items()), key=repr)
    found = grouping_rollup(df, gf)
    assert rows(found, "player_id", "team_id", "season", "gid", "total_points", "total_wins", "home_win_rows") == expected


@pytest.mark.parametrize("gid, columns", [(PLAYER_TEAM, ["player_id", "team_id"]), (PLAYER_SEASON, ["player_id", "season"]), (TEAM, ["team_id"])])
@pytest.mark.parametrize("measure", ["total_points", "total_wins", "home_win_rows"])
def test_one_grouping_is_a_set_of_the_rollup(season, gid, columns, measure):
    _, _, df, gf = season
    whole = grouping_rollup(df, gf).filter(F.col("gid") == gid)
    one = one_grouping(df, gf, gid, measure)
    assert rows(one, *columns, "gid", measure) == rows(whole, *columns, "gid", measure)


def test_only_groups_are_expanded(season):
    _, _, df, gf = season
    text = plan(grouping_rollup(df, gf))
    expanded = text[text.index("Expand") :]
    assert "HashAggregate" in expanded and "Exchange" in expanded[: expanded.index("SortMergeJoin")]
    leader = plan(one_grouping(df, gf, PLAYER_TEAM, "total_points"))
    assert "Expand" not in leader and "Join" not in leader and len(re.findall(r"\bExchange\b", leader)) == 1
