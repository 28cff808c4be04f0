"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import gathered


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. Edges point to smaller nodes."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Rows (node, component) for every node with an edge to another; component is the smallest node.

    Alternating large and small stars (Kiveris et al., 2014): each round is joins with aggregated
    minima, so a hub of any degree is split like any skewed key, and the rounds grow with the
    logarithm of the nodes. Each round is stored, which cuts the lineage. Loops, repeated edges and
    NULL ends are ignored; no edges give no rows.
    """
    a, b = F.col(left), F.col(right)
    current = gathered(
        edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges",
    )
    seen = None
    while True:
        figures = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if figures[0] == 0 or figures == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = figures
        current = gathered(_small_star(_large_star(current).distinct()).distinct(), "edges")
