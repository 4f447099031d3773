"""Connected components as joins and aggregations, for graphs of any shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spagyric.session import shared_checkpoints


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: every larger neighbour of a node is linked to the least of its neighbourhood. Small star:
    so are the node and its smaller neighbours."""
    both = edges.select("u", "v")
    around = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = around.join(least, "u")
    out = linked.where("v > u") if large else linked.where("v <> m")
    out = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.where("u <> m").select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge table (u, v); component is the least node.

    Alternates large and small stars, which halves paths; lineage is cut by checkpoints. No group of rows
    is ever gathered: hubs only meet aggregations and equi-joins that can be split.
    """
    shared_checkpoints(edges.sparkSession)
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    before = None
    for _ in range(most_rounds):
        edges = _star(_star(edges, large=True), large=False).checkpoint()
        after = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = after
    raise RuntimeError(f"components: no fixed point in {most_rounds} rounds")
