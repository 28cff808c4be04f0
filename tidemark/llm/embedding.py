"""Near-duplicate vectors by an exact metric range join over pivot cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, column, lists, staged
from tidemark.llm.components import components

COSINE = 0.9
CELL = 4096  # vectors of a cell, on average
PIVOTS = (4, 1024)  # at least and at most
GUESTS = 4  # other cells that a vector is sent to, on average
SAMPLE = 4096  # vectors that pivots are chosen from
TILE = 512  # vectors of a tile
SQUARE = 16  # tiles of a cell that one key of the join holds
SLACK = 1e-6  # room for rounding in distances; links are decided by the cosine itself


def padded(vectors: list[np.ndarray], size: int) -> np.ndarray:
    """Unit vectors as rows, filled up with zeros."""
    rows = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        rows[i, : len(v)] = v / np.abs(v).max()
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def balanced(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that the largest component is near 1: exact, and no product leaves the range."""
    if not rows.size:
        return rows
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def few_guests(sample: np.ndarray, pivots: np.ndarray, reach: float) -> np.ndarray:
    """As many of the first pivots as leave a vector of the sample a guest in ``GUESTS`` cells or fewer, on average.

    Where vectors are too far from any pivot for the triangle inequality to tell cells apart, more cells only mean
    more copies of each vector; larger cells are compared tile by tile instead.
    """
    count = len(pivots)
    while count > PIVOTS[0]:
        far = np.sqrt(np.maximum(0.0, 2 - 2 * sample @ pivots[:count].T))
        home = far.argmin(axis=1)
        radii = np.full(count, -1.0)
        np.maximum.at(radii, home, far.min(axis=1))
        between = np.sqrt(np.maximum(0.0, 2 - 2 * pivots[:count] @ pivots[:count].T))
        if len(guests(far, home, between, radii, reach)[0]) <= GUESTS * len(sample):
            break
        count = max(PIVOTS[0], count // 2)
    return pivots[:count]


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: each next one has the largest distance to those before."""
    if not len(sample):
        return sample
    chosen = [0]
    nearest = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(count, len(sample)):
        best = int(nearest.argmax())
        if nearest[best] <= SLACK:
            break
        chosen.append(best)
        nearest = np.minimum(nearest, np.linalg.norm(sample - sample[best], axis=1))
    return sample[chosen]


def guests(
    distances: np.ndarray, home: np.ndarray, between: np.ndarray, radii: np.ndarray, reach: float
) -> tuple[np.ndarray, np.ndarray]:
    """(vector, cell) for the cells of smaller number that may hold a vector within reach.

    Triangle inequality: such a vector y of cell j has d(y, p_j) <= radius_j, so d(x, p_j) <= radius_j +
    reach; and y is on the other side of the plane halfway between the two pivots, from which x is
    (d(x, p_j)^2 - d(x, p_home)^2) / (2 d(p_j, p_home)) away.
    """
    own = distances[np.arange(len(home)), home]
    plane = (distances**2 - own[:, None] ** 2) / np.maximum(2 * between[home], 1e-9)
    near = (plane <= reach + SLACK) & (distances <= radii[None, :] + reach + SLACK)
    near &= np.arange(distances.shape[1])[None, :] < home[:, None]
    return np.nonzero(near)


def tile_links(
    a: np.ndarray, b: np.ndarray, own: bool, cosine: float
) -> tuple[np.ndarray, list[tuple[int, int]], list[tuple[int, int]]]:
    """Links of two tiles of raw vectors: a matrix, and stars that span its components (aa, ab edges)."""
    a, b = balanced(a), balanced(b)
    scale = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    links = (a @ b.T) / scale >= cosine
    if own:
        np.fill_diagonal(links, False)
    in_a, in_b = [], []
    open_rows = links.any(axis=1)
    for first in np.flatnonzero(open_rows):
        if not open_rows[first]:
            continue
        found_a, found_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        fresh = np.array([first])
        while len(fresh):
            found_a[fresh] = True
            reached = links[fresh].any(axis=0) & ~found_b
            found_b |= reached
            fresh = np.flatnonzero(links[:, reached].any(axis=1) & ~found_a)
        open_rows &= ~found_a
        in_a.extend((int(first), int(i)) for i in np.flatnonzero(found_a) if i != first)
        in_b.extend((int(first), int(i)) for i in np.flatnonzero(found_b))
    return links, in_a, in_b


def embedding_links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Stored rows of links between distinct vectors: (node, n) and (node, other).

    ``vectors`` is stored: node, vec (finite, not zero), n (copies). For every node, ``n`` adds up to the number of
    copies of other nodes with a cosine of ``cosine`` or more; (node, other) are some of these links, enough to connect
    what all of them connect.

    On the unit sphere a cosine is a distance, so this is a range join in a metric space. Each vector belongs to the
    cell of its nearest pivot, and is a guest in the cells of smaller number that may hold a
    partner; so every pair meets in one cell, the smaller of the two. Cells are cut into tiles, and
    the tile pairs of a large cell are dealt to a grid of keys, so no cell meets in one task.
    """
    spark = vectors.sparkSession
    total, size = vectors.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    kind = "node long, other long, n long"
    if not total:
        return spark.createDataFrame([], kind)
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    sample = vectors.select("vec").orderBy(F.xxhash64("vec")).limit(SAMPLE).collect()
    count = min(PIVOTS[1], max(PIVOTS[0], -(-total // CELL)))
    units = padded([np.array(r["vec"]) for r in sample], size)
    pivots = few_guests(units, choose_pivots(units, count), reach)
    shared = spark.sparkContext.broadcast(pivots)

    def distance(batch: pa.RecordBatch) -> np.ndarray:
        cosines = padded(lists(batch.column("vec")), size) @ shared.value.T
        return np.sqrt(np.maximum(0.0, 2 - 2 * cosines))

    def find_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = distance(batch)
                home = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(home.astype(np.int32)), pa.array(far.min(axis=1))],
                    names=[*batch.schema.names, "home", "far"],
                )

    homes = staged(
        vectors.select("node", "n", "vec").mapInArrow(find_home, "node long, n long, vec array<double>, home int, far double"),
        "homes",
    )
    radii = np.full(len(pivots), -1.0)
    for row in homes.groupBy("home").agg(F.max("far").alias("far")).collect():  # a row per pivot
        radii[row["home"]] = row["far"]
    between = np.sqrt(np.maximum(0.0, 2 - 2 * pivots @ pivots.T))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            home = batch.column("home").to_numpy()
            which, cell = guests(distance(batch), home, between, radii, reach)
            index = np.concatenate([np.arange(len(home)), which])
            taken = pa.array(index)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(taken) for c in ("node", "n", "vec")),
                    pa.array(np.concatenate([home, cell]).astype(np.int32)), pa.array(index_guest(len(home), len(which))),
                ],
                names=["node", "n", "vec", "cell", "guest"],
            )

    def index_guest(own: int, more: int) -> np.ndarray:
        return np.concatenate([np.zeros(own, bool), np.ones(more, bool)])

    placed = homes.mapInArrow(send, "node long, n long, vec array<double>, cell int, guest boolean").withColumn(
        "dims", F.size("vec")
    )
    groups = ["cell", "dims", "guest"]
    sizes = placed.groupBy(*groups).agg(F.count(F.lit(1)).alias("rows"))
    tile = F.pmod(F.xxhash64("node"), F.ceil(F.col("rows") / F.lit(TILE))).cast("int")
    tiles = staged(
        # A row per cell, dimension and role.
        placed.join(F.broadcast(sizes), groups)
        .groupBy(*groups, tile.alias("tile"))
        .agg(F.collect_list(F.struct("node", "n", "vec")).alias("items"))
        .select(*groups, "tile", F.col("items.node").alias("nodes"), F.col("items.n").alias("copies"), F.flatten("items.vec").alias("values")),
        "tiles",
    )
    squares = tiles.groupBy("cell", "dims").agg(
        F.ceil(F.sqrt(F.count(F.lit(1)) / F.lit(SQUARE))).cast("int").alias("side")
    )
    sized = tiles.join(F.broadcast(squares), ["cell", "dims"])
    every = F.explode(F.sequence(F.lit(0), F.col("side") - 1))
    mine = sized.filter("NOT guest").select(
        "cell", "dims", F.pmod("tile", "side").alias("line"), every.alias("column"),
        F.col("tile").alias("tile_a"), F.col("nodes").alias("nodes_a"), F.col("copies").alias("copies_a"), F.col("values").alias("values_a"),
    )
    theirs = sized.select(
        "cell", "dims", every.alias("line"), F.pmod("tile", "side").alias("column"),
        "guest", "tile", "nodes", "copies", "values",
    )
    pairs = mine.join(theirs, ["cell", "dims", "line", "column"]).filter("guest OR tile_a <= tile").select(
        "dims", "nodes_a", "copies_a", "values_a", "nodes", "copies", "values", (~F.col("guest") & (F.col("tile_a") == F.col("tile"))).alias("same")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: lists(batch.column(c)) for c in ("nodes_a", "copies_a", "values_a", "nodes", "copies", "values")}
            node, other, n = [], [], []
            for i, (dims, same) in enumerate(zip(batch.column("dims").to_pylist(), batch.column("same").to_pylist(), strict=True)):
                a, b = cols["values_a"][i].reshape(-1, dims), cols["values"][i].reshape(-1, dims)
                links, in_a, in_b = tile_links(a, b, same, cosine)
                if not in_b:
                    continue
                a_nodes, b_nodes = cols["nodes_a"][i].tolist(), cols["nodes"][i].tolist()
                for names, sums in ((a_nodes, links @ cols["copies"][i]), (b_nodes, None if same else cols["copies_a"][i] @ links)):
                    for at in np.flatnonzero(sums) if sums is not None else ():
                        node.append(names[at])
                        other.append(None)
                        n.append(int(sums[at]))
                edges = [(a_nodes[x], a_nodes[y]) for x, y in in_a] + [(a_nodes[x], b_nodes[y]) for x, y in in_b]
                node.extend(x for x, _ in edges)
                other.extend(y for _, y in edges)
                n.extend([0] * len(edges))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (node, other, n)], names=["node", "other", "n"]
            )

    with arrow_rows(spark, 16):
        return staged(pairs.mapInArrow(compare, kind), "links")


def embedding_classes(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE
) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of ``table``.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components link with nothing, and vectors of
    different dimensions never link. Equal vectors are one node with a count, so a group of copies of
    any size is one row; each of its rows links with all others. Rows with a NULL key take part;
    component_id is the smallest key in reach, and NULL if there is none. Repeated rows are vectors of their own.
    """
    rows = table.select(column(key).alias("vec_id"), column(vector).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.coalesce(finite & F.exists("vec", lambda v: v != 0), F.lit(False))
    distinct = staged(
        rows.filter(good).groupBy("vec").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")), "vectors"
    )
    vectors = staged(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    links = embedding_links(vectors, cosine)
    counted = links.groupBy("node").agg(F.sum("n").alias("linked"))
    member = components(links.filter("other IS NOT NULL"), "node", "other")
    known = (
        vectors.join(counted, "node", "left").join(member, "node", "left")
        .select("vec", "least", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    first = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(first, "component").select("vec", "n_links", "component_id")
    linked = rows.filter(good).join(known, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
