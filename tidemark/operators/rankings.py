"""Top-1 answers over match data.

Tables are reduced to the grain of the question before they are joined. The join of medals and
details on the match alone repeats every detail row once per medal row; the same figures follow
from one weight per match, without those rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.skew import broadcast_if_small


def _rows_per_match(df: DataFrame, match: str, name: str) -> DataFrame:
    return df.groupBy(match).agg(F.count(F.lit(1)).alias(name))


def played_matches(
    matches: DataFrame, details: DataFrame, medals: DataFrame, match: str = "match_id"
) -> DataFrame:
    """Matches that the three-way join reaches: those with details and medals."""
    known = matches
    for side in (details, medals):
        known = known.join(side.select(match).distinct(), match, "left_semi")
    return known


def average_per_event(
    df: DataFrame, entity: str, measure: str, event: str, medals: DataFrame | None = None
) -> DataFrame:
    """Events, total and average of ``measure`` per entity.

    Each distinct event counts once. With ``medals`` the figures are those of the joined grain: each
    row counts once per medal row of its event.
    """
    known = df.filter(F.col(entity).isNotNull())
    if medals is None:
        events, total = F.count_distinct(F.col(event)), F.sum(measure)
    else:
        known = known.join(_rows_per_match(medals, event, "_weight"), event)
        events, total = F.sum("_weight"), F.sum(F.col(measure) * F.col("_weight"))
    sums = known.groupBy(entity).agg(events.alias("num_events"), total.alias("total"))
    return sums.withColumn("average", F.col("total") / F.col("num_events"))


def top_average(
    df: DataFrame, entity: str, measure: str, event: str, medals: DataFrame | None = None,
    k: int = 1,
) -> DataFrame:
    """Entity with the highest average per event; the entity itself decides a tie."""
    averages = average_per_event(df, entity, measure, event, medals)
    return averages.orderBy(F.col("average").desc_nulls_last(), F.col(entity).asc_nulls_last()).limit(k)


def most_frequent(
    df: DataFrame, group: str, distinct_key: str, keep_null_group: bool = False, k: int = 1
) -> DataFrame:
    """Group with the most distinct keys. Rows without a group are left out unless asked for."""
    known = df if keep_null_group else df.filter(F.col(group).isNotNull())
    counts = known.groupBy(group).agg(F.count_distinct(F.col(distinct_key)).alias("num_keys"))
    return counts.orderBy(F.col("num_keys").desc(), F.col(group).asc_nulls_last()).limit(k)


def medal_rows(
    medals: DataFrame, matches: DataFrame, details: DataFrame | None = None,
    match: str = "match_id",
) -> DataFrame:
    """Medal rows with the columns of their match.

    With ``details``, ``count`` is that of the joined grain: multiplied by the detail rows of the
    match.
    """
    if details is not None:
        weights = _rows_per_match(details, match, "_weight")
        medals = medals.join(weights, match).withColumn("count", F.col("count") * F.col("_weight"))
        medals = medals.drop("_weight")
    return medals.join(matches, match)


def top_group_for_lookup(
    df: DataFrame,
    dim: DataFrame,
    name: str,
    group: str,
    measure: str,
    dim_key: str = "medal_id",
    dim_name: str = "name",
    k: int = 1,
) -> DataFrame:
    """Group with the largest sum of ``measure`` over the rows whose dimension entry has ``name``.

    All entries of that name count. The lookup is a semi join inside the same plan, broadcast if its
    checked size allows.
    """
    entries = broadcast_if_small(dim.filter(F.col(dim_name) == name).select(dim_key).distinct())
    hits = df.join(entries, dim_key, "left_semi").filter(F.col(group).isNotNull())
    sums = hits.groupBy(group).agg(F.sum(measure).alias("total"))
    return sums.orderBy(F.col("total").desc_nulls_last(), F.col(group).asc_nulls_last()).limit(k)
