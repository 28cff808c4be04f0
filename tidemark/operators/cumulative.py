"""Cumulative entity snapshots: one row per entity and period with its whole history in an array.

A snapshot row holds the entity, ``page``, a label, the array of items, tier, activity and period.
An array cannot hold an unbounded number of items in one row. A table whose entities may have more
items than a row can hold gets ``pages`` pages: every entity has all of them from its first period
on, an item is on the page that a hash of its id names, and label, tier and activity stand on each.
The number is the caller's, so the form of a result does not depend on its size, and a snapshot
built period by period equals one built at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.tiers import tier


@dataclass(frozen=True)
class EntityTable:
    """Column names of the source rows and of the snapshot."""

    key: str = "actorid"
    label: str = "actor"
    period: str = "year"
    measure: str = "rating"
    item_id: str = "filmid"
    item_fields: tuple[str, ...] = ("year", "film", "votes", "rating", "filmid")
    items: str = "films"
    tier: str = "quality_class"
    active: str = "is_active"
    snapshot_period: str = "current_year"

    @property
    def snapshot_columns(self) -> tuple[str, ...]:
        return (
            self.key, "page", self.label, self.items, self.tier, self.active, self.snapshot_period
        )


ACTORS = EntityTable()


def _items(table: EntityTable) -> Column:
    """The items of a group as an array ordered by item id."""
    item = F.struct(*table.item_fields)
    pairs = F.sort_array(F.collect_list(F.struct(F.col(table.item_id).alias("id"), item.alias("item"))))
    return F.transform(pairs, lambda pair: pair["item"])


def _period_figures(table: EntityTable) -> list[Column]:
    return [F.max(table.label).alias(table.label), F.avg(table.measure).alias("_average")]


def period_rows(rows: DataFrame, table: EntityTable = ACTORS, pages: int = 1) -> DataFrame:
    """One row per (entity, period, page) with the items of the page, the label and the average.

    Rows with a NULL key belong to no entity.
    """
    rows = rows.filter(F.col(table.key).isNotNull())
    unit = [table.key, table.period]
    if pages == 1:
        # Lists do not shrink map-side: one shuffle on the entity serves both this grouping and the
        # grouping by entity that a backfill adds.
        return (
            rows.repartition(table.key)
            .groupBy(*unit)
            .agg(_items(table).alias(table.items), *_period_figures(table))
            .withColumn("page", F.lit(0))
        )
    page = F.pmod(F.xxhash64(table.item_id), F.lit(pages)).cast("int")
    lists = (
        rows.withColumn("page", page)
        .groupBy(table.key, "page", table.period)
        .agg(_items(table).alias(table.items))
    )
    every_page = F.explode(F.sequence(F.lit(0), F.lit(pages - 1))).alias("page")
    heads = rows.groupBy(*unit).agg(*_period_figures(table)).select("*", every_page)
    return heads.join(lists, [table.key, "page", table.period], "left").withColumn(
        table.items, F.coalesce(table.items, _no_items(lists, table))
    )


def _no_items(df: DataFrame, table: EntityTable) -> Column:
    return F.array().cast(df.schema[table.items].dataType)


def cumulate_entities(
    prev: DataFrame,
    current: DataFrame,
    period: int,
    table: EntityTable = ACTORS,
    pages: int = 1,
) -> DataFrame:
    """Snapshot of ``period`` from the snapshot of ``period - 1`` and the rows of ``period``.

    Items of this period are appended; the tier follows this period's average, or stays as it was
    for an entity without rows. An empty ``prev`` starts the table; ``pages`` is the same for all
    periods of a table.
    """
    old = prev.filter((F.col(table.snapshot_period) == period - 1) & F.col(table.key).isNotNull())
    new = period_rows(current.filter(F.col(table.period) == period), table, pages)
    old, new = old.alias("old"), new.alias("new")
    none = _no_items(new, table)
    present = F.col(f"new.{table.period}").isNotNull()
    # Snapshots of one page may be stored by entity alone.
    unit = [table.key] if pages == 1 else [table.key, "page"]
    return old.join(new, unit, "full").select(
        table.key,
        F.lit(0).alias("page") if pages == 1 else "page",
        F.coalesce(f"old.{table.label}", f"new.{table.label}").alias(table.label),
        F.concat(
            F.coalesce(f"old.{table.items}", none), F.coalesce(f"new.{table.items}", none)
        ).alias(table.items),
        F.when(present, tier("_average")).otherwise(F.col(f"old.{table.tier}")).alias(table.tier),
        present.alias(table.active),
        F.lit(period).alias(table.snapshot_period),
    )


def entity_history(
    rows: DataFrame,
    through: int,
    table: EntityTable = ACTORS,
    pages: int = 1,
    with_items: bool = True,
    since: int | None = None,
) -> DataFrame:
    """All snapshots up to ``through`` at once, from each entity's first period on.

    ``since`` leaves out the snapshots of earlier periods, not their items. Without items only key,
    tier, activity and period are returned, and only (entity, period) averages are kept: they are
    combined map-side, and the group of an entity is bounded by the number of periods.
    """
    rows = rows.filter(F.col(table.key).isNotNull())
    rows, unit = rows.filter(F.col(table.period) <= through), [table.key]
    known = [F.col(table.period).alias("period"), F.col("_average").alias("average")]
    if with_items:
        periods = period_rows(rows, table, pages)
        known += [F.col(table.label).alias("label"), F.col(table.items).alias("items")]
        # A constant page would keep Spark from seeing that the rows are partitioned already.
        unit += ["page"] if pages > 1 else []
    else:
        average = F.avg(table.measure).alias("_average")
        periods = rows.groupBy(table.key, table.period).agg(average)
    # One entry per period: at most as many as there are periods.
    entity = periods.groupBy(*unit).agg(F.sort_array(F.collect_list(F.struct(*known))).alias("known"))
    if "page" not in unit:
        entity = entity.withColumn("page", F.lit(0))
    # Items and tier change only in active periods: they are built once in each and repeated until
    # the next one.
    spans = entity.select(table.key, "page", "known", F.posexplode("known").alias("place", "latest"))
    following = F.try_element_at("known", F.col("place") + F.lit(2))["period"]
    until = F.coalesce(following - F.lit(1), F.lit(through))
    active = F.col("latest.period")
    start = active if since is None else F.greatest(active, F.lit(since))
    columns = {
        table.tier: tier(F.col("latest.average")),
        "_active": active,
        "_periods": F.sequence(start, until),
    }
    if with_items:
        sofar = F.slice("known", F.lit(1), F.col("place") + F.lit(1))
        columns[table.label] = F.col("known")[0]["label"]
        columns[table.items] = F.flatten(F.transform(sofar, lambda x: x["items"]))
    grid = (
        spans.filter(start <= until)
        .withColumns(columns)
        .drop("known", "place", "latest")
        .withColumn(table.snapshot_period, F.explode("_periods"))
        .withColumn(table.active, F.col("_active") == F.col(table.snapshot_period))
    )
    wanted = [c for c in table.snapshot_columns if c in grid.columns]
    if not with_items:
        wanted.remove("page")
    return grid.select(*wanted)
