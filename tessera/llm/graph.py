"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point each node's larger (large) or smaller-or-equal neighbours at its smallest neighbour.

    The minimum per node is summed map-side; the join's other side is one row a node,
    so a node with very many neighbours only makes a skewed join that AQE splits.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "node")
    joined = both.join(least, F.col("a") == F.col("node"))
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("x"), "m")
    else:
        moved = joined.where("b < a").select(F.col("b").alias("x"), "m").unionByName(joined.where("b < a").select(F.col("a").alias("x"), "m"))
    return moved.where("x <> m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct()


def components(spark: SparkSession, edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (a, b) but the smallest of each.

    Each round is written to the shared folder; it ends when a round changes nothing.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), spark)
    mark = None
    for _ in range(most_rounds):
        edges = written(_star(_star(edges, large=True), large=False), spark)
        now = tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
