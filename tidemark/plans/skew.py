"""Size checks: which tables may be broadcast, which keys must be split."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
MAX_ROWS_PER_KEY = 5_000_000
MAX_LOCAL_KEYS = 20_000
CELLS = 1 << 20


def is_small(
    df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> bool:
    """Whether ``df`` holds at most ``max_rows`` rows of at most ``max_bytes`` in total."""
    rows, size = measured(df)
    return rows <= max_rows and size <= max_bytes


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows of ``df`` and their bytes, about.

    One aggregation over the table, combined map-side; only two numbers reach the driver.
    """
    width = sum((_width(df, field) for field in df.schema), F.lit(0).cast("bigint"))
    return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first())


def _width(df: DataFrame, field: T.StructField) -> Column:
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(df[field.name]), F.lit(0)).cast("bigint") + F.lit(16)
    if isinstance(field.dataType, T.AtomicType):
        return F.lit(16).cast("bigint")
    return F.coalesce(F.octet_length(F.to_json(F.struct(df[field.name]))), F.lit(0)) + F.lit(16)


def broadcast_if_small(
    df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """``df`` with a broadcast hint if its size was checked, else unchanged.

    Beyond the bound the join shuffles, and AQE splits the skewed partitions of the other side.
    """
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


@dataclass(frozen=True)
class HotKeys:
    """Keys that hold more than ``max_rows`` rows, with their row count ``hot_n``."""

    table: DataFrame
    keys: tuple[str, ...]
    max_rows: int
    local: bool

    def mark(self, df: DataFrame, into: str = "hot_n") -> DataFrame:
        """Left join on the keys, NULL keys included; the hot columns are NULL for other keys."""
        hot = self.table.withColumnsRenamed(
            {key: f"hot_{key}" for key in self.keys} | {"hot_n": into}
        )
        same = reduce(
            Column.__and__, (df[key].eqNullSafe(hot[f"hot_{key}"]) for key in self.keys)
        )
        return df.join(hot, same, "left").drop(*(f"hot_{key}" for key in self.keys))

    def parts(self, count: str = "hot_n") -> Column:
        """Into how many parts the rows of a key are to be split; 1 for keys that are not hot."""
        return F.ceil(F.coalesce(F.col(count), F.lit(1)) / F.lit(self.max_rows)).cast("int")


def find_hot_keys(
    df: DataFrame, keys: Sequence[str], max_rows: int = MAX_ROWS_PER_KEY, cells: int = CELLS
) -> HotKeys | None:
    """Keys with more than ``max_rows`` rows, or None if there are none.

    Keys are first counted in ``cells`` cells of a hash, combined map-side, so what is shuffled is bounded by the cells
    and not by the keys. A hot key fills its cell, so only keys of full cells are counted one by one; there are none in
    the usual case. At most rows / ``max_rows`` cells and keys can be so; up to ``MAX_LOCAL_KEYS`` of them are kept as a
    local table and broadcast, a longer list stays distributed.
    """
    cell = F.pmod(F.xxhash64(*keys), F.lit(cells)).alias("hot_cell")
    full = df.groupBy(cell).agg(F.count(F.lit(1)).alias("hot_n")).filter(F.col("hot_n") > max_rows).select("hot_cell")
    crowded = full.take(MAX_LOCAL_KEYS + 1)
    if not crowded:
        return None
    if len(crowded) <= MAX_LOCAL_KEYS:
        full = F.broadcast(df.sparkSession.createDataFrame(crowded, full.schema))
    suspects = df.select(*keys, cell).join(full, "hot_cell", "left_semi")
    hot = suspects.groupBy(*keys).agg(F.count(F.lit(1)).alias("hot_n")).filter(F.col("hot_n") > max_rows)
    rows = hot.take(MAX_LOCAL_KEYS + 1)
    if not rows:
        return None
    local = len(rows) <= MAX_LOCAL_KEYS
    if local:
        hot = F.broadcast(df.sparkSession.createDataFrame(rows, hot.schema))
    return HotKeys(hot, tuple(keys), max_rows, local)


def rows_bound(
    df: DataFrame, keys: Sequence[str], max_rows: int = MAX_ROWS_PER_KEY
) -> int | None:
    """``max_rows`` if some key of ``df`` exceeds it, else None: no later scan has to look again.

    Meant for the table an ordered scan is built from, which is cheaper to count than its joins.
    """
    return None if find_hot_keys(df, keys, max_rows) is None else max_rows


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    hot_left: HotKeys | None = None,
    hot_right: HotKeys | None = None,
) -> DataFrame:
    """Inner or left join on ``key`` in which the rows of a hot key are spread over many tasks.

    The pairs of a hot key form a grid: a left row takes one line of it by a hash of the row and is
    copied along that line, a right row likewise takes one column. Every pair meets in exactly one
    cell. Other keys have a single cell.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins keep left rows unique under salting")
    if hot_left is None and hot_right is None:
        return left.join(right, key, how)

    def grid(df: DataFrame, own: str, other: str) -> DataFrame:
        spread = df
        sizes = {}
        for hot, side in ((hot_left, "line"), (hot_right, "column")):
            sizes[side] = F.lit(1)
            if hot is not None:
                spread = hot.mark(spread, f"_{side}_n")
                sizes[side] = hot.parts(f"_{side}_n")
        return spread.select(
            *df.columns,
            F.pmod(F.xxhash64(*df.columns), sizes[own]).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), sizes[other] - F.lit(1))).alias(other),
            (sizes["column"] > F.lit(1)).alias(f"_{own}_split"),
        )

    joined = grid(left, "line", "column").join(
        grid(right, "column", "line"), [key, "line", "column"], how
    )
    # A key with split right rows has matches; a left copy that met none of them in its cell is not
    # an unmatched row.
    empty_cell = F.col("_line_split") & F.col("_column_split").isNull()
    return joined.filter(~empty_cell).select(
        *left.columns, *(c for c in right.columns if c != key)
    )
