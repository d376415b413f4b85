"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) and an equi-join that deals nodes with very many
neighbours to several tasks, so that a hub is never gathered in one. Edges go to a table in the shared folder after
every round. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import materialise, spread_join


def _state(edges: DataFrame) -> tuple:
    """Row count and an order-free digest: equal only if the edges are the same."""
    both = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(both)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour above a node moves to the node's smallest neighbour (or to the node)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return spread_join(edges, least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its neighbours below it move to the smallest of them. Edges have u < v."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = spread_join(edges, least, "v").where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return moved.union(least.select(F.col("m").alias("u"), "v")).distinct()


def connected_components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """(node, component): every node that has an edge, with the smallest node it reaches.

    ``edges`` has columns u and v of one orderable type, in either order, repeats and loops
    allowed; rows holding a null take no part. No edges: no rows.
    """
    ordered = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    current = materialise(ordered, name)
    before = _state(current)
    while before[0]:
        current = materialise(_small_star(_large_star(current)), name)
        now = _state(current)
        if now == before:
            break
        before = now
    below = current.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return below.union(current.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
