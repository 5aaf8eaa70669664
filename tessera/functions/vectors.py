"""Vector shapes: dense and sparse forms, subvectors, Z-order, padding."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def as_bool(v: Column) -> Column:
    return F.transform(v, lambda x: x != 0)


def width(dimension: int, parts: int) -> int:
    """Entries per subvector; the dimension must divide evenly."""
    if parts < 1 or dimension % parts:
        raise ValueError(f"dimension {dimension} does not divide into {parts} subvectors")
    return dimension // parts


def split(v: Column, parts: int, dimension: int) -> Column:
    """Array of `parts` contiguous subvectors; rows of another length raise."""
    w = width(dimension, parts)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda m: F.slice(v, m * w + 1, w))
    wrong = F.raise_error(F.concat(F.lit(f"vector is not of dimension {dimension}: "), F.size(v).cast("string")))
    return F.when(F.size(v) == dimension, pieces).otherwise(wrong)


def subvectors(vectors: DataFrame, parts: int, dimension: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Long table (key, m, sv): one row per subvector."""
    pieces = split(as_double(F.col(vector)), parts, dimension)
    return vectors.select(key, F.posexplode(pieces).alias("m", "sv"))


def densify(cells: Column, dimension: int) -> Column:
    """0/1 vector of a set of cells; for small dimensions only."""
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.array_contains(cells, i).cast("double"))


def active_cells(v: Column) -> Column:
    """Positions of positive entries, ascending."""
    return F.filter(F.transform(v, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())


def sparse_subvectors(vectors: DataFrame, parts: int, dimension: int, key: str = "vec_id") -> DataFrame:
    """(key, m, cells within the subvector) of sparse vectors (key, cells), empty ones included."""
    w = width(dimension, parts)
    piece = lambda m: F.transform(F.filter("cells", lambda c: F.floor(c / w) == m), lambda c: (c % w).cast("int"))
    return vectors.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), piece)).alias("m", "cells"))


def parse_cells(line: Column) -> Column:
    """Sorted distinct integers of a line separated by commas or white space."""
    tokens = F.filter(F.split(line, r"[,\s]+"), lambda t: t != "")
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda t: t.cast("int"))))


def fix_dimension(v: Column, size: int = 512) -> Column:
    """Padded with zeros or cut to `size` entries."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), size)), 1, size)


def morton(row: Column, col: Column, bits: int = 16) -> Column:
    """Interleaved code: bits of row at even places, of col at odd ones."""
    code = F.lit(0).cast("long")
    for b in range(bits):
        code = code.bitwiseOR(F.shiftleft(F.shiftright(row.cast("long"), b).bitwiseAND(F.lit(1)), 2 * b))
        code = code.bitwiseOR(F.shiftleft(F.shiftright(col.cast("long"), b).bitwiseAND(F.lit(1)), 2 * b + 1))
    return code


def zorder(spark: SparkSession, dimension: int) -> DataFrame:
    """(rank, cell) of a square grid's cells along the Z curve; a table of one row per grid cell."""
    side = isqrt(dimension)
    if side * side != dimension:
        raise ValueError(f"dimension {dimension} is not a square")
    cells = spark.range(dimension).select(F.col("id").cast("int").alias("cell"))
    code = morton(F.floor(F.col("cell") / side), F.col("cell") % side)
    return cells.select("cell", (F.row_number().over(Window.orderBy(code)) - 1).alias("rank")).select("rank", "cell")


def zorder_cells(dimension: int) -> list[int] | None:
    """The grid cells in Z order, or None where the dimension is no square and order stays as it is."""
    side = isqrt(dimension)
    if side * side != dimension:
        return None
    spread = lambda n: sum(((n >> b) & 1) << (2 * b) for b in range(16))
    return sorted(range(dimension), key=lambda c: spread(c // side) | spread(c % side) << 1)


def zorder_dense(v: Column, dimension: int) -> Column:
    order = zorder_cells(dimension)
    return v if order is None else F.transform(F.array(*[F.lit(c) for c in order]), lambda c: F.get(v, c))


def zorder_sparse(spark: SparkSession, vectors: DataFrame, dimension: int, key: str = "vec_id") -> DataFrame:
    """(key, cells) with cells renumbered by Z rank; one row per grid cell is joined, the grid being of fixed size."""
    ranks = zorder(spark, dimension)
    moved = vectors.select(key, F.explode_outer("cells").alias("cell")).join(ranks, "cell", "left")
    return moved.groupBy(key).agg(F.array_sort(F.collect_list("rank")).alias("cells"))
