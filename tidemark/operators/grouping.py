"""Several groupings of game details in one pass, and the leaders of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# grouping_id over (player_id, team_id, season): a set bit marks a column that is rolled up.
PLAYER_TEAM = 0b001
PLAYER_SEASON = 0b010
TEAM = 0b101


COLUMNS = ("player_id", "team_id", "season")
SETS = {PLAYER_TEAM: ("player_id", "team_id"), PLAYER_SEASON: ("player_id", "season"), TEAM: ("team_id",)}


def _won(team: str = "team_id") -> Column:
    """Whether the team of a row has won its game: at home if the home team won, away if it did not."""
    return (F.col(team) == F.col("home_team_id")) == (F.col("home_team_wins") == 1)


def _facts(details: DataFrame, games: DataFrame) -> DataFrame:
    return details.select("game_id", "player_id", "team_id", "pts").join(
        games.select("game_id", "season", "home_team_id", "home_team_wins"), "game_id", "left"
    )


def _measures() -> dict[str, Column]:
    """Measures from rows or from sums over them. ``total_wins`` adds up where groups share no game of a team."""
    return {
        "total_points": F.coalesce(F.sum("total_points"), F.lit(0.0)),
        "total_wins": F.coalesce(F.sum("total_wins"), F.lit(0)),
        "home_win_rows": F.coalesce(F.sum("home_win_rows"), F.lit(0)),
    }


def _finest(facts: DataFrame) -> DataFrame:
    """All measures by (player, team, season), from which the sets are rolled up.

    Wins are counted once for a game: by (player, team, season, game) first, so a hot team or player is spread over its
    games. A game has one season, so the wins of a player in a team, or in a season, are sums of these.
    """
    return facts.groupBy(*COLUMNS).agg(
        F.sum("pts").alias("total_points"),
        F.count_distinct(F.when(_won(), F.col("game_id"))).alias("total_wins"),
        F.sum("home_team_wins").alias("home_win_rows"),
    )


def _team_wins(details: DataFrame, games: DataFrame) -> DataFrame:
    """Games won by each team: pairs of game and team, whatever the number of their players."""
    sides = details.select("game_id", "team_id").distinct()
    won = sides.join(games.select("game_id", "home_team_id", "home_team_wins"), "game_id").filter(_won())
    return won.groupBy("team_id").agg(F.count(F.lit(1)).alias("total_wins"))


def grouping_rollup(details: DataFrame, games: DataFrame) -> DataFrame:
    """Points and wins by (player, team), (player, season) and (team).

    ``total_wins`` counts every game won by a team once: at home if the home team won, away if it
    did not. ``home_win_rows`` adds the home-win flag once per detail row instead. The grouping is
    told by ``gid``, so a genuine NULL key is not taken for a rolled-up one.

    Rows are aggregated once, by all three columns, and only those groups are rolled up to the sets. The wins of teams,
    which their players share, come from pairs of game and team.
    """
    finest = _finest(_facts(details, games))
    sets = [[F.col(c) for c in columns] for columns in SETS.values()]
    rolled = finest.groupingSets(sets, *COLUMNS).agg(
        F.grouping_id().cast("int").alias("gid"), *(c.alias(n) for n, c in _measures().items())
    )
    wins = _team_wins(details, games).select(
        F.col("team_id").alias("won_team"), F.col("total_wins").alias("team_wins"), F.lit(TEAM).alias("won_gid")
    )
    of_teams = (F.col("gid") == F.col("won_gid")) & (F.col("team_id") == F.col("won_team"))
    total = F.when(F.col("gid") == TEAM, F.coalesce("team_wins", F.lit(0))).otherwise(F.col("total_wins"))
    return rolled.join(wins, of_teams, "left").withColumn("total_wins", total).drop("won_team", "won_gid", "team_wins")


def one_grouping(details: DataFrame, games: DataFrame, gid: int, measure: str) -> DataFrame:
    """One set of ``grouping_rollup`` with one measure: the columns of the set, ``gid`` and the measure.

    One aggregate over the rows, and a join only if the set or the measure asks for the game.
    """
    columns = SETS[gid]
    if measure == "total_wins" and gid == TEAM:
        teams, wins = details.select("team_id").distinct(), _team_wins(details, games)
        found = teams.join(wins.withColumnRenamed("team_id", "won_team"), F.col("team_id") == F.col("won_team"), "left")
        found = found.select("team_id", F.coalesce("total_wins", F.lit(0)).alias("total_wins"))
    elif measure == "total_points" and "season" not in columns:
        found = details.groupBy(*columns).agg(F.coalesce(F.sum("pts"), F.lit(0.0)).alias(measure))
    elif measure == "total_wins":
        facts = _facts(details, games)
        won = F.when(_won(), F.struct("game_id", "team_id"))
        found = facts.groupBy(*columns).agg(F.count_distinct(won).alias(measure))
    else:
        facts = _facts(details, games.select("game_id", "season", "home_team_id", "home_team_wins"))
        source = {"total_points": "pts", "home_win_rows": "home_team_wins"}[measure]
        zero = F.lit(0.0) if measure == "total_points" else F.lit(0)
        found = facts.groupBy(*columns).agg(F.coalesce(F.sum(source), zero).alias(measure))
    return found.withColumn("gid", F.lit(gid))


def top_of_grouping(
    rollup: DataFrame, gid: int, measure: str, ties: list[str | Column], k: int = 1
) -> DataFrame:
    """The ``k`` first rows of one grouping by ``measure``; ``ties`` decide between equal values."""
    ordered = rollup.filter(F.col("gid") == gid).orderBy(
        F.col(measure).desc_nulls_last(), *ties
    )
    return ordered.limit(k)
