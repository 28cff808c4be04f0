"""Shards of near equal bytes: a k-d tree over document metadata, split at weighted medians.

Every node has a range of shards. A node with more than one is split along its widest dimension, where the bytes below
are to the bytes above as the shards it gives to either side; a node with one shard is a leaf of about the target bytes.
All nodes of a depth are split by the same few jobs: one for bytes and extent of each node, then one for each narrowing
of the cells that hold the medians. The tree is a number of splits for the number of shards, never of rows.

Everything here is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import column, discard, numbered, staged, unused

SHARDS = 40
ROW_BYTES = 16  # of a document besides its text
CELLS = 1024  # that a range of keys is cut into at a time
TOLERANCE = 1e-4  # of a leaf's bytes: a median need not be told more closely
SCALE = (1 << 31) - 1


@dataclass(frozen=True)
class Split:
    """Rows of node ``at`` whose (key of ``dim``, row number) is not below (key, row) go to node ``upper``."""

    at: int
    dim: int
    key: int
    row: int
    upper: int


@dataclass
class Search:
    """Where the median of a node is looked for: keys, or row numbers of the one key ``key``."""

    dim: int
    target: float
    low: int
    high: int
    below: int = 0
    key: int | None = None


def default_dims(docs: DataFrame, text: str) -> dict[str, Column]:
    """Source and language by their hashes, where ``docs`` has them, and the logarithm of the length of the text."""
    names = {c.lower(): c for c in docs.columns}
    found = {
        d: F.shiftrightunsigned(F.xxhash64(column(names[d]).cast("string")), 33).cast("double")
        for d in ("source", "lang")
        if d in names and names[d] != text
    }
    return {**found, "length": F.log1p(F.coalesce(F.octet_length(column(text)), F.lit(0)).cast("double"))}


def described(docs: DataFrame, dims: Mapping[str, Column], key: str, text: str, row: Column) -> DataFrame:
    """Rows (doc_id, size, text_crc32, row, d0, d1, ...) without texts, written once."""
    body = F.coalesce(column(text), F.lit(""))
    return staged(
        docs.select(
            column(key).alias("doc_id"),
            (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            row.alias("row"),
            # NaN sorts above all numbers and would have no place between them.
            *(F.coalesce(F.nanvl(c.cast("double"), F.lit(None)), F.lit(0.0)).alias(f"d{i}") for i, c in enumerate(dims.values())),
        ),
        "metadata",
    )


def keyed(rows: DataFrame, count: int) -> DataFrame:
    """With keys k0, k1, ...: the place of a value between the least and the greatest, then a hash of the document.

    The hash deals out rows of equal value evenly; what still has one key is told apart by its row number.
    """
    ends = rows.agg(*(f(f"d{i}").alias(f"{n}{i}") for i in range(count) for n, f in (("a", F.min), ("b", F.max)))).first()
    tie = F.shiftrightunsigned(F.xxhash64("doc_id"), 32)

    def key(i: int) -> Column:
        low, high = ends[f"a{i}"] or 0.0, ends[f"b{i}"] or 0.0
        wide = (high / 2 - low / 2) * 2 if high > low else 0.0  # no overflow of the halves
        place = F.lit(0).cast("long") if not 0 < wide < float("inf") else F.least(
            F.floor((F.col(f"d{i}") - low) / wide * SCALE).cast("long"), F.lit(SCALE)
        )
        return F.shiftleft(place, 32).bitwiseOR(tie)

    names = [c for c in rows.columns if not c.startswith("d") or c == "doc_id"]
    return rows.select(*names, *(key(i).alias(f"k{i}") for i in range(count)))


def by_node(found: Mapping[int, tuple], names: tuple[str, ...], shards: int) -> Column:
    """The values for the node ``at`` of a row, NULL if there are none: a literal with a place for each shard."""
    nothing = (None,) * len(names)
    table = F.array(*(
        F.struct(*(F.lit(v).cast("double" if n == "wanted" else "long").alias(n) for n, v in zip(names, found.get(node, nothing), strict=True)))
        for node in range(shards)
    ))
    return F.element_at(table, F.col("at") + 1)


def _key(count: int, dim: Column) -> Column:
    return F.element_at(F.array(*(F.col(f"k{i}") for i in range(count))), (dim + 1).cast("int"))


def moved(rows: DataFrame, splits: list[Split], count: int, shards: int) -> DataFrame:
    """``rows`` with ``at`` one level further down."""
    split = F.col("split")
    key = _key(count, split["dim"])
    above = (key > split["key"]) | ((key == split["key"]) & (F.col("row") >= split["row"]))
    table = {s.at: (s.dim, s.key, s.row, s.upper) for s in splits}
    return (
        rows.withColumn("split", by_node(table, ("dim", "key", "row", "upper"), shards))
        .withColumn("at", F.when(above, split["upper"].cast("int")).otherwise(F.col("at")))
        .drop("split")
    )


def weighted_medians(
    rows: DataFrame, searches: dict[int, Search], count: int, shards: int, tolerance: float
) -> dict[int, tuple[int, int]]:
    """For each node the (key, row) with as many bytes below it as its search asks, nearest to the border of a row.

    Each round counts the bytes in cells of the range that is left, and goes on in the cell with the median, between
    the least and greatest key in it. It ends with a row, or a cell that weighs less than ``tolerance``.
    """
    found: dict[int, tuple[int, int]] = {}
    while searches:
        spans = {
            node: (s.dim, s.low, s.high, (s.high - s.low) // CELLS + 1, s.key, s.target - s.below)
            for node, s in searches.items()
        }
        span, value = F.col("span"), F.col("value")
        names = ("dim", "low", "high", "width", "only", "wanted")
        key = _key(count, span["dim"])
        cells = (
            rows.withColumn("span", by_node(spans, names, shards))
            .filter(span["only"].isNull() | (key == span["only"]))
            .withColumn("value", F.when(span["only"].isNull(), key).otherwise(F.col("row")))
            .filter(value.between(span["low"], span["high"]))
            .groupBy("at", span["wanted"].alias("wanted"), F.floor((value - span["low"]) / span["width"]).alias("cell"))
            .agg(F.sum("size").alias("bytes"), F.min("value").alias("least"), F.max("value").alias("most"))
        )
        order = Window.partitionBy("at").orderBy("cell")  # CELLS rows and a few for rounding
        upto = F.sum("bytes").over(order)
        hits = (
            cells.withColumn("upto", upto)
            .filter((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("bytes") < F.col("wanted")))
            .collect()
        )
        again: dict[int, Search] = {}
        for hit in hits:
            s = searches[hit["at"]]
            before = s.below + hit["upto"] - hit["bytes"]
            if hit["least"] < hit["most"] and hit["bytes"] > tolerance:
                again[hit["at"]] = Search(s.dim, s.target, hit["least"], hit["most"], before, s.key)
            elif s.key is None and hit["least"] == hit["most"] and hit["bytes"] > tolerance:
                again[hit["at"]] = Search(s.dim, s.target, 0, (1 << 62) - 1, before, hit["least"])
            else:  # the whole cell to the side that it fits better
                cut = hit["most"] + 1 if before + hit["bytes"] / 2 < s.target else hit["least"]
                found[hit["at"]] = (cut, 0) if s.key is None else (s.key, cut)
        for node in searches.keys() - {hit["at"] for hit in hits}:
            raise RuntimeError(f"node {node} has no rows where its median is")
        searches = again
    return found


def kd_leaves(rows: DataFrame, count: int, shards: int) -> DataFrame:
    """``rows``, keyed, with their leaf ``at``. Nodes are named by the first of their shards.

    The narrow rows are written anew for each depth, with the node they are in, and the files before are deleted: so
    no job goes through the splits of all depths above, and a lost executor costs one depth.
    """
    sizes = {0: shards}
    here = staged(rows.withColumn("at", F.lit(0)), "nodes")
    while any(n > 1 for n in sizes.values()):
        ends = [f(f"k{i}").alias(f"{n}{i}") for i in range(count) for n, f in (("a", F.min), ("b", F.max))]
        nodes = {r["at"]: r for r in here.groupBy("at").agg(F.sum("size").alias("bytes"), *ends).collect()}
        searches, leaf = {}, 1.0
        for node, n in sizes.items():
            if n > 1 and (r := nodes.get(node)) is not None:  # a node without rows stays without
                wide = max(range(count), key=lambda i, r=r: ((r[f"b{i}"] >> 32) - (r[f"a{i}"] >> 32), -i))
                searches[node] = Search(wide, r["bytes"] * (n // 2) / n, r[f"a{wide}"], r[f"b{wide}"])
                leaf = max(leaf, r["bytes"] / n)
        cuts = weighted_medians(here, searches, count, shards, leaf * TOLERANCE)
        splits = [Split(a, searches[a].dim, *cut, a + sizes[a] // 2) for a, cut in sorted(cuts.items())]
        below = staged(moved(here, splits, count, shards), "nodes")
        discard(here)
        here = below
        sizes = {
            a: n
            for node, m in sizes.items()
            for a, n in ([(node, m // 2), (node + m // 2, m - m // 2)] if m > 1 else [(node, m)])
        }
    return here


def with_slots(rows: DataFrame, shard: str, *order: str) -> DataFrame:
    """``rows`` with ``slot``: their number in their shard, from 0, in the given order.

    Ranges of (shard, order) are sorted apart and written, so a shard may fill many tasks; the counts of each range and
    shard, a row for each of them, are added up.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, shard, *order).sortWithinPartitions(shard, *order)
    at = F.monotonically_increasing_id()
    stored = staged(dealt.select("*", F.spark_partition_id().alias("part"), at.alias("at")), "slots")
    counts = stored.groupBy("part", shard).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy(shard).orderBy("part")) - F.col("n")
    starts = counts.select("part", shard, (before - F.col("first")).alias("shift"))
    # At most one row for each range and one more for each shard.
    return stored.join(F.broadcast(starts), ["part", shard]).withColumn("slot", F.col("at") + F.col("shift"))


def kd_shards(
    docs: DataFrame,
    shards: int | None = SHARDS,
    target_bytes: int | None = None,
    dims: Mapping[str, Column] | None = None,
    key: str = "doc_id",
    text: str = "text",
    row: str | None = None,
) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot, row), one for each row of ``docs``.

    ``size`` is the UTF-8 bytes of the text and 16 more. Shards are numbered from 0, as many as asked for, or as leaves
    of ``target_bytes`` need; their bytes differ by a few documents. ``slot`` counts the rows of a shard by key. A NULL
    text is empty; NULL or NaN metadata counts as 0; NULL keys come first. Equal rows, and rows of equal metadata, are
    dealt by a hash of the key and then by ``row``, a column that numbers the rows
    (if there is none, their place in the table), so a group of any size is split where it
    must be. A document is never cut: one longer than a shard's share makes that shard larger. An empty table gives no
    rows. Other columns are read only if ``dims`` asks for them, whatever their names.
    """
    dims = dims or default_dims(docs, text)
    stored = described(docs, dims, key, text, column(row) if row else F.monotonically_increasing_id())
    if target_bytes is not None:
        total = stored.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    leaves = kd_leaves(keyed(stored, len(dims)), len(dims), shards)
    discard(stored)
    placed = leaves.select("doc_id", "size", "text_crc32", "row", F.col("at").alias("shard"))
    found = with_slots(placed, "shard", "doc_id", "row")
    discard(leaves)
    return found.select("doc_id", "size", "text_crc32", "shard", "slot", "row")


def write_shards(docs: DataFrame, path: str, file_rows: int = 100_000, **options) -> DataFrame:
    """Write ``docs``, a stored table, as Parquet in a folder for each shard; the rows of ``kd_shards``.

    Files hold ``file_rows`` consecutive slots, so a shard is written by many tasks. A column named ``shard`` or
    ``slot`` is kept under its name with an underscore before it.
    """
    renamed = docs.select(*(column(c).alias(unused(docs, c) if c.lower() in ("shard", "slot") else c) for c in docs.columns))
    row = unused(renamed, "_row")
    rows = numbered(renamed, row)
    placed = kd_shards(rows, row=row, **options)
    whole = rows.join(placed.select(F.col("row").alias(row), "shard", "slot"), row)
    file = unused(whole, "file")
    (
        whole.withColumn(file, F.floor(F.col("slot") / file_rows))
        .repartition("shard", file)
        .sortWithinPartitions("shard", "slot")
        .drop(row, file)
        .write.partitionBy("shard")
        .parquet(path)
    )
    return placed
