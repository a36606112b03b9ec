"""Connected components by alternating large-star and small-star steps.

Every step is a minimum per node, combined before the shuffle, and a join of
the edges with it, whose skewed partitions adaptive execution splits; no list
of neighbours is ever gathered. Edges are written to the shared folder once per
round, so a lost executor never costs more than the round at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from machinepulse.llm.common import partitions, stored


# Rows of edges in a partition, about 5 MB.
_ROWS = 200_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node.

    Self-loops, repeated edges and edges with a null end count for nothing. No
    edges give an empty table.
    """
    now = stored(
        edges.where("a != b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct(),
        "edges",
    )
    before, count = None, _signature(now)
    while count != before and count[0]:
        parts = partitions(count[0], _ROWS)
        now = stored(_small_star(_large_star(now, parts), parts), "edges")
        before, count = count, _signature(now)
    leaves = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return leaves.unionByName(roots)


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Tie every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(parts)
    return (
        both.join(least, "u")
        .where("v > u")
        .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        .coalesce(parts)
        .distinct()
        .coalesce(parts)
    )


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m")).coalesce(parts)
    moved = (
        edges.join(least, "hi")
        .where("lo != m")
        .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        .coalesce(parts)
    )
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct().coalesce(parts)


def _signature(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("hi", "lo").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mixed)).first())
