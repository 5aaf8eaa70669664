"""Product quantization of sparse binary vectors, given as sorted arrays of their active cells.

Nothing here has an array of the dimension's length.  A subset is what a vector
has in one subspace: (vec_id, m, cells), cells counted from the subspace's first.
A codebook is (m, k, cells, weights): a centroid's cells and its values there, all
1 where it is a member and means where it is not.  A task holds a codebook as
inverted lists, for each cell of a subspace the centroids that have it; the lists
of a subset's cells, merged, give its overlap with every centroid at once, and all
metrics here are functions of the overlap and of both sizes.

Codebooks are sent in blocks of at most BLOCK_BYTES; each block names its nearest
centroid, and the nearest of the blocks' is taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import EPS
from ..functions.vectors import width
from .lineage import cut

BLOCK_BYTES = 64 << 20
#: Entries (subset, centroid) whose overlaps a task holds at once.
CELLS_AT_ONCE = 1 << 22
SHARES = 64

#: From the overlap of a set and a centroid, the set's size, and the sum of the centroid's squares, which of a set is its size.
Distance = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _jaccard(empty: float) -> Distance:
    def distance(overlap: np.ndarray, size: np.ndarray, other: np.ndarray) -> np.ndarray:
        either = size + other - overlap
        return np.where(either == 0, empty, 1 - overlap / np.where(either == 0, 1, either))

    return distance


DISTANCES: dict[str, Distance] = {
    "jaccard": _jaccard(1.0),
    "jaccard0": _jaccard(0.0),
    "gjaccard": lambda overlap, size, other: 1 - overlap / (size + other - overlap + EPS),
    "l2sq": lambda overlap, size, other: np.maximum(size - 2 * overlap + other, 0),
    "l2": lambda overlap, size, other: np.sqrt(np.maximum(size - 2 * overlap + other, 0)),
    "hamming": lambda overlap, size, other: size - 2 * overlap + other,
}
#: Metrics of sets only: their centroids must be sets, too.
OF_SETS = ("jaccard", "jaccard0", "gjaccard", "hamming")


def _checked(by: str) -> Distance:
    if by not in DISTANCES:
        raise ValueError(f"unknown metric of sparse vectors {by!r}; known: {', '.join(DISTANCES)}")
    return DISTANCES[by]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and n + 1 offsets of a list column, null lists as empty ones."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])


def _as_lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values).cast(kind))


def split_cells(cells: np.ndarray, offsets: np.ndarray, parts: int, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells in their subspaces, offsets of the n x parts subsets) of sorted cells of n vectors."""
    if len(cells) and (cells.min() < 0 or cells.max() >= dimension):
        raise ValueError(f"a cell is outside a vector of dimension {dimension}")
    w, n = width(dimension, parts), len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    number = row * parts + cells // w
    if (np.diff(row * np.int64(dimension) + cells) <= 0).any():
        raise ValueError("cells must be sorted and distinct")
    return cells % w, np.searchsorted(number, np.arange(n * parts + 1))


def subsets(vectors: DataFrame, parts: int, dimension: int, key: str = "vec_id") -> DataFrame:
    """(key, m, cells) of vectors (key, cells): one row per subspace, empty ones included."""
    width(dimension, parts)
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, offsets = split_cells(*_lists(batch["cells"]), parts, dimension)
            n = batch.num_rows
            row = pa.array(np.repeat(np.arange(n), parts))
            yield pa.RecordBatch.from_arrays([batch[key].take(row), pa.array(np.tile(np.arange(parts, dtype=np.int32), n)), _as_lists(cells, offsets, pa.int32())], names=[key, "m", "cells"])

    return vectors.select(key, "cells").mapInArrow(run, f"{key} {kind}, m int, cells array<int>")


def distinct_subsets(sub: DataFrame) -> DataFrame:
    """(m, cells, n): the subsets of each subspace with how often they occur."""
    return sub.groupBy("m", "cells").agg(F.count("*").alias("n"))


def first_sets(sub: DataFrame, ks: int) -> DataFrame:
    """The first ks distinct subsets of each subspace in the order of their 0/1 vectors, as a codebook.

    They are ranked in SHARES shares of each subspace first, so that at most SHARES x ks of a subspace meet in a task.
    """
    # Of two 0/1 vectors the one that has the first cell where they differ comes last: lists of negated cells have that order.
    ranked = sub.select("m", F.transform("cells", lambda c: -c).alias("back")).distinct().withColumn("share", F.pmod(F.xxhash64("back"), F.lit(SHARES)))
    for keys in (["m", "share"], ["m"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("back"))).where(F.col("rank") <= ks)
    return as_codebook(ranked.select("m", (F.col("rank") - 1).alias("k"), F.transform("back", lambda c: -c).alias("cells")))


def as_codebook(sets: DataFrame) -> DataFrame:
    """(m, k, cells, weights) of centroids (m, k, cells) that are sets."""
    return sets.select("m", "k", "cells", F.transform("cells", lambda _: F.lit(1.0)).alias("weights"))


@dataclass
class Inverted:
    """Centroids of one subspace: their numbers, sums of squares, and for each cell which of them have it and how much."""

    number: np.ndarray
    squares: np.ndarray
    first: np.ndarray
    which: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, number: np.ndarray, cells: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> Inverted:
        which = np.repeat(np.arange(len(number)), np.diff(offsets))
        squares = np.bincount(which, weights * weights, len(number))
        order = np.argsort(cells, kind="stable")
        cells = cells[order]
        first = np.searchsorted(cells, np.arange((int(cells[-1]) if len(cells) else -1) + 2))
        return cls(number, squares, first, which[order], weights[order])

    def overlaps(self, cells: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each set its weighted overlap with each centroid: the lists of its cells, merged."""
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        known = cells < len(self.first) - 1
        row, cells = row[known], cells[known]
        low, n = self.first[cells], self.first[cells + 1] - self.first[cells]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        size = len(self.number)
        return np.bincount(np.repeat(row, n) * size + self.which[at], self.weight[at], (len(offsets) - 1) * size).reshape(-1, size)

    def distances(self, cells: np.ndarray, offsets: np.ndarray, by: str) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first set, last set, distances to all centroids), some sets at a time."""
        sizes, step = np.diff(offsets), max(1, CELLS_AT_ONCE // max(1, len(self.number)))
        for i in range(0, len(sizes), step):
            j = min(i + step, len(sizes))
            part = slice(int(offsets[i]), int(offsets[j]))
            yield i, j, DISTANCES[by](self.overlaps(cells[part], offsets[i : j + 1] - offsets[i]), sizes[i:j, None].astype(float), self.squares[None, :])


def _blocks(codebook: DataFrame) -> Iterator[dict[int, Inverted]]:
    """The codebook's inverted lists by subspace, in blocks of at most BLOCK_BYTES by its own size."""
    size = codebook.agg(F.sum(F.size("cells") * 20 + 32)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for b in range(blocks):
        part = codebook if blocks == 1 else codebook.where(F.pmod(F.xxhash64("m", "k"), F.lit(blocks)) == b)
        rows = part.select("m", "k", "cells", "weights").toArrow().sort_by([("m", "ascending"), ("k", "ascending")]).combine_chunks()
        m, out = rows["m"].to_numpy(), {}
        for p in np.unique(m).tolist():
            own = rows.filter(pa.array(m == p)).combine_chunks()
            if own.num_rows:
                cells, offsets = _lists(own["cells"].chunk(0))
                out[p] = Inverted.of(own["k"].to_numpy(), cells, offsets, _lists(own["weights"].chunk(0))[0].astype(float))
        yield out


def _nearest(block: dict[int, Inverted], m: int, cells: np.ndarray, offsets: np.ndarray, by: str) -> tuple[np.ndarray, np.ndarray]:
    """(k, distance) of sets of subspace m: ties go to the lowest k; -1 and infinity where the block has no centroid of it."""
    n = len(offsets) - 1
    k, d = np.full(n, -1, np.int64), np.full(n, np.inf)
    if m in block:
        for i, j, found in block[m].distances(cells, offsets, by):
            best = found.argmin(1)
            k[i:j], d[i:j] = block[m].number[best], found[np.arange(j - i), best]
    return k, d


def assign_sets(sub: DataFrame, codebook: DataFrame, by: str = "jaccard") -> DataFrame:
    """sub (..., m, cells) with k and d, its nearest centroid and distance; ties go to the lowest k."""
    _checked(by)
    names, out = sub.columns, None
    spark, schema = sub.sparkSession, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sub.schema) + ", k int, d double"
    blocks = 0
    for block in _blocks(codebook):
        shared, blocks = spark.sparkContext.broadcast(block), blocks + 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m, (cells, offsets) = batch["m"].to_numpy(), _lists(batch["cells"])
                k, d = np.full(len(m), -1, np.int64), np.full(len(m), np.inf)
                for p in np.unique(m).tolist():
                    at = np.flatnonzero(m == p)
                    size = np.diff(offsets)[at]
                    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(offsets[at], size)
                    k[at], d[at] = _nearest(shared.value, p, cells[place], np.concatenate([[0], np.cumsum(size)]), by)
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(k).cast(pa.int32()), pa.array(d)], names=[*names, "k", "d"])

        found = sub.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if blocks == 1:
        return out.where("k >= 0")
    best = out.where("k >= 0").groupBy(*names).agg(F.min(F.struct("d", "k")).alias("best"))
    return best.select(*names, F.col("best.k").alias("k"), F.col("best.d").alias("d"))


def encode_sets(vectors: DataFrame, codebook: DataFrame, parts: int, dimension: int, by: str = "jaccard", key: str = "vec_id") -> DataFrame:
    """(key, codes) of sparse vectors (key, cells): a map over them where the codebook is one block."""
    _checked(by)
    width(dimension, parts)
    kind = vectors.schema[key].dataType.simpleString()
    spark, out = vectors.sparkSession, None
    blocks = 0
    for block in _blocks(codebook):
        shared, blocks = spark.sparkContext.broadcast(block), blocks + 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                cells, offsets = split_cells(*_lists(batch["cells"]), parts, dimension)
                row, part = np.divmod(np.repeat(np.arange(n * parts), np.diff(offsets)), parts)
                order = np.argsort(part, kind="stable")
                bounds = np.searchsorted(part[order], np.arange(parts + 1))
                codes, near = np.full((n, parts), -1, np.int64), np.full((n, parts), np.inf)
                for p in range(parts):
                    mine = order[bounds[p] : bounds[p + 1]]
                    codes[:, p], near[:, p] = _nearest(shared.value, p, cells[mine], np.searchsorted(row[mine], np.arange(n + 1)), by)
                ends = np.arange(n + 1) * parts
                yield pa.RecordBatch.from_arrays([batch[key], _as_lists(codes.ravel(), ends, pa.int32()), _as_lists(near.ravel(), ends, pa.float64())], names=[key, "codes", "near"])

        found = vectors.select(key, "cells").mapInArrow(run, f"{key} {kind}, codes array<int>, near array<double>")
        out = found if out is None else out.unionByName(found)
    if blocks == 1:
        return out.select(key, "codes")
    each = out.groupBy(key).agg(*[F.min(F.struct(F.get("near", F.lit(p)).alias("d"), F.get("codes", F.lit(p)).alias("k"))).alias(f"b{p}") for p in range(parts)])
    return each.select(key, F.array(*[F.col(f"b{p}.k") for p in range(parts)]).alias("codes"))


def set_tables(queries: DataFrame, codebook: DataFrame, parts: int, dimension: int, by: str = "jaccard") -> DataFrame:
    """(qid, lut) of sparse queries (qid, cells), qid a long: per subspace the distances to its centroids, by number."""
    _checked(by)
    sub, spark, out = subsets(queries, parts, dimension, "qid"), queries.sparkSession, None
    for block in _blocks(codebook):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for qid, m, cells in zip(batch["qid"], batch["m"].to_pylist(), batch["cells"], strict=True):
                    if m in shared.value:
                        at = cells.values.to_numpy(zero_copy_only=False)
                        _, _, d = next(shared.value[m].distances(at, np.array([0, len(at)]), by))
                        k = shared.value[m].number
                        yield pa.RecordBatch.from_arrays([pa.array([qid.as_py()] * len(k), pa.int64()), pa.array([m] * len(k), pa.int32()), pa.array(k).cast(pa.int32()), pa.array(d[0])], names=["qid", "m", "k", "d"])

        found = sub.mapInArrow(run, "qid long, m int, k int, d double")
        out = found if out is None else out.unionByName(found)
    per = out.groupBy("qid", "m").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda e: e["d"]).alias("row"))
    return per.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "row"))), lambda e: e["row"]).alias("lut"))


def updated_means(assigned: DataFrame, codebook: DataFrame) -> DataFrame:
    """The codebook of the clusters' means, from weighted subsets (m, k, cells, n); empty clusters keep their centroid."""
    size = assigned.groupBy("m", "k").agg(F.sum("n").alias("size"))
    each = assigned.select("m", "k", F.explode("cells").alias("cell"), "n").groupBy("m", "k", "cell").agg(F.sum("n").alias("n"))
    lists = each.groupBy("m", "k").agg(F.array_sort(F.collect_list(F.struct("cell", "n"))).alias("list"))
    means = size.join(lists, ["m", "k"], "left").select("m", "k", F.transform("list", lambda e: e["cell"]).alias("c"), F.transform("list", lambda e: e["n"] / F.col("size")).alias("w"), F.lit(True).alias("full"))
    joined = codebook.join(means, ["m", "k"], "left")
    none = F.array().cast("array<int>")
    pick = lambda new, old, empty: F.when(F.col("full"), F.coalesce(new, empty)).otherwise(F.col(old))
    return joined.select("m", "k", pick(F.col("c"), "cells", none).alias("cells"), pick(F.col("w"), "weights", none.cast("array<double>")).alias("weights"))


def train_sets(sub: DataFrame, ks: int, by: str = "jaccard0", max_steps: int = 50) -> tuple[DataFrame, bool]:
    """(codebook, converged) from the first ks subsets: medoids for metrics of sets, means for l2sq, until the codebook stays."""
    from .medoids import summed_medoids

    _checked(by)
    points = cut(distinct_subsets(sub))
    book = cut(first_sets(sub, ks))
    for _ in range(max_steps):
        found = cut(assign_sets(points, book, by))
        if by in OF_SETS:
            chosen = summed_medoids(found.select("m", "k", F.col("cells").alias("sv"), "n"), by, sets=True)
            new = as_codebook(book.select("m", "k", F.col("cells").alias("old")).join(chosen, ["m", "k"], "left").select("m", "k", F.coalesce("centroid", "old").alias("cells")))
        else:
            new = updated_means(found, book)
        new = cut(new)
        if new.exceptAll(book).isEmpty():
            return new, True
        book = new
    return book, False
