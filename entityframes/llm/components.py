"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum and an equi-join on node ids, so no neighbour list is ever
collected; adaptive execution splits the join of a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _star(directed: DataFrame, large: bool) -> DataFrame:
    """Attach the neighbours v of each u to the least node around u: the larger ones, or all smaller ones and u."""
    least = directed.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = directed.join(least, "u")
    out = joined.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")) if large else (
        joined.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))))
    return out.filter("a <> b").distinct()


def connected_components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the least node reachable.

    Links may repeat, point either way, or join a node to itself (ignored). Nodes without a link to
    another node are not returned.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    edges, before = materialise(edges, "stars"), None
    for _ in range(most_rounds):
        large = _star(_both_ways(edges), large=True)
        small = _star(large.select(F.col("b").alias("u"), F.col("a").alias("v")), large=False)
        edges = materialise(small, "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    # every node is now linked to its component's least node, and to nothing else
    members = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return members.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
