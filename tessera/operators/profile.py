"""How repetitive and how empty the subvectors of a collection are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_double, split


def divisors(dimension: int) -> list[int]:
    """Numbers of subvectors that divide the dimension, the dimension itself left out."""
    return [m for m in range(1, dimension) if dimension % m == 0]


#: Log of a sketch's buckets: a relative standard error of 1.04 / sqrt(2^12), 1.6 %.
SKETCH_BITS = 12


def unique_profile(vectors: DataFrame, dimension: int, parts: list[int] | None = None, sketch: bool = False) -> DataFrame:
    """(parts, m, n_unique): distinct subvectors per subspace for each way to split, in one scan.

    With `sketch` they are estimates from sketches of their hashes, which tasks make and merge, so that no subvector
    is shuffled.
    """
    def way(p: int) -> Column:
        return F.transform(split(as_double(F.col("embedding")), p, dimension), lambda sv, m: F.struct(F.lit(p).alias("parts"), m.alias("m"), sv.alias("sv")))

    each = vectors.select(F.explode(F.flatten(F.array(*[way(p) for p in parts or divisors(dimension)]))).alias("e")).select("e.parts", "e.m", "e.sv")
    if sketch:
        return each.groupBy("parts", "m").agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64("sv"), F.lit(SKETCH_BITS))).alias("n_unique"))
    return each.groupBy("parts", "m").agg(F.count_distinct("sv").alias("n_unique"))


def zero_profile(sub: DataFrame) -> DataFrame:
    """(m, zero_columns, zero_subvectors): columns that are zero in all rows, and rows that are zero in all columns."""
    zero = F.forall("sv", lambda x: x == 0)
    rows = sub.groupBy("m").agg(F.count_if(zero).alias("zero_subvectors"))
    columns = sub.select("m", F.posexplode("sv").alias("j", "x")).groupBy("m", "j").agg(F.max(F.col("x") != 0).alias("used"))
    return columns.groupBy("m").agg(F.count_if(~F.col("used")).alias("zero_columns")).join(rows, "m")
