"""One row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.boxscore import box_score_flags

GAME_COLUMNS = ("game_id", "game_date_est", "season", "home_team_id")


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]
) -> DataFrame:
    """The first row of every key. ``order`` must be total within a key, else the pick is arbitrary.

    Spark limits every key to one row per task before the shuffle (WindowGroupLimit), so a key with
    very many copies does not gather in one task.
    """
    if not order:
        raise ValueError("an order is needed to make the pick repeatable")
    scan = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(scan)).filter("_place = 1").drop("_place")


def dedup_facts(
    details: DataFrame,
    games: DataFrame,
    order: Sequence[str | Column],
    keys: Sequence[str] = ("game_id", "team_id", "player_id"),
    games_order: Sequence[str | Column] = ("game_date_est", "season", "home_team_id"),
) -> DataFrame:
    """One row per (game, team, player) of a known game, with the game's date, season and home team.

    Both sides are reduced before they meet, so copies are neither joined nor shuffled twice.
    """
    if "game_id" not in keys:
        raise ValueError("the key must contain game_id")
    one_game = first_per_key(games.select(*GAME_COLUMNS), ["game_id"], games_order)
    return first_per_key(details, keys, order).join(one_game, "game_id")


def dedup_box_scores(
    details: DataFrame, games: DataFrame, order: Sequence[str | Column]
) -> DataFrame:
    """Deduplicated facts with home flag, comment flags and minutes."""
    return box_score_flags(dedup_facts(details, games, order))


def dedup_dimension(
    df: DataFrame,
    order: Sequence[str | Column],
    keys: Sequence[str] = ("device_id", "browser_type", "device_type", "os_type"),
) -> DataFrame:
    """One device row per (device, browser, device type, operating system), id as text."""
    return first_per_key(df, keys, order).withColumn("device_id", F.col("device_id").cast("string"))
