"""Derived columns of a game-detail (box score) row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes looked for in the comment, with the flag column each one feeds.
COMMENT_FLAGS = {
    "DNP": "dim_did_not_play",
    "DND": "dim_did_not_dress",
    "NWT": "dim_not_with_team",
}


def comment_flag(comment: Column | str, code: str) -> Column:
    """Whether the comment holds ``code``; a missing comment is False, never NULL."""
    comment = F.col(comment) if isinstance(comment, str) else comment
    return F.coalesce(comment.contains(code), F.lit(False))


def minutes_played(text: Column | str) -> Column:
    """``mm:ss`` as fractional minutes.

    Seconds that are absent or not a number count as 0; without readable minutes the result is
    NULL.
    """
    text = F.col(text) if isinstance(text, str) else text
    minutes, seconds = (
        F.split_part(text, F.lit(":"), F.lit(part)).try_cast("double") for part in (1, 2)
    )
    return minutes + F.coalesce(seconds, F.lit(0.0)) / F.lit(60.0)


def box_score_flags(df: DataFrame) -> DataFrame:
    """Add the home flag, the comment flags and ``minutes``; rename ``TO`` to ``turnovers``.

    Reads ``team_id``, ``home_team_id``, ``comment``, ``min`` and, if present, ``TO``.
    """
    derived = {"dim_is_playing_at_home": F.col("team_id") == F.col("home_team_id")}
    derived |= {name: comment_flag("comment", code) for code, name in COMMENT_FLAGS.items()}
    derived["minutes"] = minutes_played("min")
    return df.withColumns(derived).withColumnRenamed("TO", "turnovers")
