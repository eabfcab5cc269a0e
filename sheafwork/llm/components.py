"""Connected components of an edge table, without gathering any component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MAX_ROUNDS = 60


def _star(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour, itself included: (u, v, m). The minimum is summed up before the shuffle."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node on an edge (a, b); the component is its smallest node.

    Alternates large-star and small-star steps: every node links its larger neighbours, then its smaller
    ones, to the smallest it knows. Nodes end up as leaves of their component's smallest node after a
    number of rounds that grows with the logarithm of the component's size. Each round's edges are cut
    off in the checkpoint folder. Loops and repeated edges change nothing; no edges give no rows.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    signature = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _star(large.where("u > v"))
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = cut(small.where("u > v").distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == signature:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        signature = seen
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
