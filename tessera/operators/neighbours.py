"""Pairs of sets within a Jaccard distance, by an inverted index of their prefixes.

Cells are ordered by how many sets of a group hold them, rarest first.  Sets of
similarity t or more share a cell among the first size - ceil(t size) + 1 of each:
only these prefixes are indexed.  Index keys are (group, cell, band of sizes): a
band spans a factor of 1 / t, so a set meets its own band and the next smaller one.
A pair is met once, at the first cell that both prefixes hold, and only if the
places of that cell leave room for enough further ones.  What is left is verified
by the sets themselves.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Against rounding in sizes times a similarity.
TINY = 1e-9


def near_sets(sets: DataFrame, eps: float) -> DataFrame:
    """(m, a, b, d), a and b ids and a <> b once each, of non-empty sets (id, m, cells) of one m at most eps apart.

    ids are distinct, cells distinct within a set, and 0 <= eps < 1: at a distance of 1 all sets are near.
    """
    if not 0 <= eps < 1:
        raise ValueError(f"eps must be at least 0 and below 1, got {eps}")
    t = 1 - eps
    full = sets.where(F.size("cells") > 0).select("id", "m", "cells")
    often = full.select("m", F.explode("cells").alias("cell")).groupBy("m", "cell").agg(F.count("*").alias("often"))
    ranked = full.select("id", "m", F.size("cells").alias("size"), F.explode("cells").alias("cell")).join(often, ["m", "cell"])
    ordered = ranked.groupBy("id", "m", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("often", "cell"))), lambda e: e["cell"]).alias("cells"))
    length = (F.col("size") - F.ceil(F.col("size") * t - TINY) + 1).cast("int")
    band = F.lit(0) if eps == 0 else F.floor(F.log(F.col("size").cast("double")) / -log(t) + TINY)
    ordered = cut(ordered.withColumn("prefix", F.slice("cells", 1, length)).withColumn("band", band.cast("int") if eps else F.col("size")))
    posting = lambda s: ordered.select(F.col("id").alias(s), "m", F.col("size").alias(f"size_{s}"), F.col("prefix").alias(f"prefix_{s}"), "band", F.posexplode("prefix").alias(f"at_{s}", "cell"))
    large = posting("a").withColumn("band", F.explode(F.array("band", F.col("band") - 1))) if eps else posting("a")
    met = large.join(posting("b"), ["m", "cell", "band"])
    # a is the larger set (ties: the larger id), so each pair has one order.
    met = met.where((F.col("size_b") < F.col("size_a")) | ((F.col("size_b") == F.col("size_a")) & (F.col("b") < F.col("a"))))
    need = F.ceil((F.col("size_a") + F.col("size_b")) * t / (1 + t) - TINY)
    room = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    met = met.where((F.col("size_b") >= F.col("size_a") * t - TINY) & (room >= need) & (F.get(F.array_intersect("prefix_a", "prefix_b"), F.lit(0)) == F.col("cell")))
    cells = lambda s: ordered.select(F.col("id").alias(s), F.col("cells").alias(f"cells_{s}"))
    both = met.select("m", "a", "b").join(cells("a"), "a").join(cells("b"), "b")
    shared = F.size(F.array_intersect("cells_a", "cells_b"))
    return both.withColumn("d", 1 - shared / (F.size("cells_a") + F.size("cells_b") - shared)).where(F.col("d") <= eps).select("m", "a", "b", "d")
