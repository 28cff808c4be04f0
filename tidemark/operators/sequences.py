"""Rolling frames and streaks over ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.ordered import CHUNK, asc, collapse_runs, cut_hot_keys, with_position
from tidemark.plans.skew import MAX_ROWS_PER_KEY


def team_games(games: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """(team_id, game_date_est, game_id, won) of the home teams; with details, of both sides.

    Details name the teams of a game; the team that is not the home team won if the home team did
    not.
    """
    home_won = F.coalesce(F.col("home_team_wins") == 1, F.lit(False))
    if details is None:
        return games.select(
            F.col("home_team_id").alias("team_id"), "game_date_est", "game_id",
            home_won.alias("won"),
        )
    sides = details.select("game_id", "team_id").distinct()
    won = (F.col("team_id") == F.col("home_team_id")) == (F.col("home_team_wins") == 1)
    return sides.join(games, "game_id").select(
        "team_id", "game_date_est", "game_id", F.coalesce(won, F.lit(False)).alias("won")
    )


def rolling_count_max(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    flag: str,
    n: int = 90,
    max_rows: int | None = MAX_ROWS_PER_KEY,
) -> DataFrame:
    """Per key, the largest number of set flags among any ``n`` consecutive rows.

    ``order`` must be unique within a key. Keys over ``max_rows`` rows are cut: rows are numbered
    across chunks, regrouped into blocks of equal length, and each block also receives the last
    ``n - 1`` rows before it, so every frame is complete.
    """
    rows, cut = cut_hot_keys(df.select(key, *order, flag), [key], order, max_rows)
    frame = (-(n - 1), Window.currentRow)
    set_flags = F.count(F.when(F.col(flag), True))
    if cut:
        block_rows = max(max_rows, n)
        place = F.col("position") - F.lit(1)
        block = F.floor(place / F.lit(block_rows))
        tail = F.pmod(place, F.lit(block_rows)) > F.lit(block_rows - n)
        homes = F.when(tail, F.array(block, block + 1)).otherwise(F.array(block))
        blocks = with_position(rows, [key], order).select(
            key, "position", flag, block.alias("home"), F.explode(homes).alias("block")
        )
        scan = Window.partitionBy(key, "block").orderBy("position").rowsBetween(*frame)
        rolled = blocks.withColumn("in_frame", set_flags.over(scan)).filter("block = home")
    else:
        scan = Window.partitionBy(key).orderBy(*asc(order)).rowsBetween(*frame)
        rolled = rows.withColumn("in_frame", set_flags.over(scan)).drop(CHUNK)
    return rolled.groupBy(key).agg(F.max("in_frame").alias("max_in_stretch"))


def streaks(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    condition: Column,
    min_len: int = 2,
    max_rows: int | None = MAX_ROWS_PER_KEY,
) -> DataFrame:
    """Runs of at least ``min_len`` consecutive rows that meet ``condition``, per key.

    A NULL condition breaks a run. ``order`` must be unique within a key; its first column gives
    ``start_date`` and ``end_date``.
    """
    rows = df.withColumn("_met", F.coalesce(condition, F.lit(False)))
    runs = collapse_runs(
        rows, [key], order, [*order, "_met"],
        breaks=lambda before, now: before("_met") != now("_met"),
        keep=lambda first, length: first("_met") & (length >= min_len),
        max_rows=max_rows,
    )
    return runs.select(
        key,
        F.col(f"first_{order[0]}").alias("start_date"),
        F.col(f"last_{order[0]}").alias("end_date"),
        F.col("n_rows").alias("streak_length"),
    )
