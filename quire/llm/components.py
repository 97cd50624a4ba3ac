"""Connected components of a graph given as edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, skew_join

#: Edges (two longs each) that one task takes whatever their ends are.
LIGHT = 1 << 17


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node is hung on the node's least neighbour (or itself)."""
    up = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = edges.select("u", "v", F.lit(0).alias("up")).union(up.select("u", "v", F.lit(1).alias("up"))).groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.sum("up").alias("n"))
    return skew_join(up, least, "u", "n", n, light=LIGHT).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """A node and its smaller neighbours are hung on the least of them. Edges point from the larger to the smaller end."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = skew_join(edges, least, "u", "n", n, light=LIGHT).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; ``root`` is the smallest node reachable.

    ``edges`` has two long columns u and v; self-loops, nulls, repeats and either direction are fine (loops and nulls are dropped).
    Each round keeps a number of edges at most linear in the input; minima are combined before the shuffle and those of
    nodes with very many neighbours are sent to the edges, so such a node doesn't gather in one task.
    Rounds are cut by checkpoints.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut(edges)
    was = _digest(edges)
    while was[0]:
        # The larger stars have at most as many edges as there were.
        edges = cut(_small_star(_large_star(edges, was[0]), was[0]))
        now = _digest(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
