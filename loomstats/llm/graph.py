"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstats.settings import cut_lineage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Tie each node's larger neighbours (large star) or its smaller ones and itself (small star) to the least of them."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    pairs = near.join(least, near["u"] == least["c"])
    if large:
        out = pairs.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("c", "m")).toDF("u", "v")
    return out.where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) of every node of the (u, v) edges; root is the least node reachable. Edges (u, u) are allowed.

    Rounds grow with the logarithm of the longest path. A star's centre is reduced before the shuffle and joined back, so
    that a centre with very many neighbours can be split by the engine's handling of skewed joins.
    """
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    current, seen = cut_lineage(edges.where("u <> v").select("u", "v").distinct()), None
    for _ in range(most_rounds):
        current = cut_lineage(_stars(_stars(current, large=True), large=False))
        state = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    return nodes.join(current, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("root"))
