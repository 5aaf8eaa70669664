"""Nearest-neighbour search over codes or vectors: lookup tables, Hamming, exact scans, top-k.

Queries are a stated set.  While they have at most BLOCK_BYTES they are sent, and
every task scans its rows once, keeping its k nearest per query, so no pair is
shuffled that a task can rule out and codes are never joined to queries.  Larger
sets meet the rows in a two-dimensional block join: query blocks by row blocks,
each pair of blocks in one task, which returns the k nearest of its rows per query.
Ties go to the smallest id.  Distances are rounded to DIGITS before ordering.

With `timed`, tasks take the time that each query's scan of their rows takes, and
results carry the sum per query as `seconds`: no driver or scheduling time is in it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.metrics import EPS, Metric, metric
from .lineage import cut

#: Bytes of lookup tables or query vectors that are sent, or stand in a block; bytes of rows in a block.
BLOCK_BYTES = 32 << 20
ROW_BLOCK_BYTES = 128 << 20
DIGITS = 9
#: Rows that a scan of vectors, and of codes, takes at once; entries of tables of several subspaces together; pairs (m, k) up to which long codes are scanned.
ROWS_AT_ONCE, CODES_AT_ONCE = 2048, 1 << 18
JOINT_ENTRIES, MOST_PAIRS = 4096, 100_000
NEAR = "qid long, vec_id long, dist double, seconds double"


def lookup_tables(query_subvectors: DataFrame, codebook: DataFrame, by: str | Metric = "l2sq") -> DataFrame:
    """(qid, m, k, d): each query's distance to every centroid, from (qid, m, sv)."""
    to = metric(by)(F.col("sv"), F.col("centroid"))
    return query_subvectors.join(codebook, "m").select("qid", "m", "k", to.alias("d"))


def packed_tables(tables: DataFrame) -> DataFrame:
    """(qid, lut): the tables of a query as arrays of distances per subspace; subspaces may differ in length."""
    per = tables.groupBy("qid", "m").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda e: e["d"]).alias("row"))
    return per.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "row"))), lambda e: e["row"]).alias("lut"))


def nearest_rows(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k smallest distances, ties by id."""
    if len(dist) > 4 * k:
        limit = np.partition(dist, k - 1)[k - 1]
        few = np.flatnonzero(dist <= limit)
        return few[np.lexsort((ids[few], dist[few]))][:k]
    return np.lexsort((ids, dist))[:k]


class _Best:
    """The k nearest rows so far of each of a table's queries, and the seconds that each has taken."""

    def __init__(self, queries: pa.Table, k: int, prepared: Callable[[pa.Table], list], distances: Callable[[np.ndarray, object], np.ndarray]):
        self.qids, self.queries, self.k, self.distances = queries["qid"].to_numpy(), prepared(queries), k, distances
        self.best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in self.qids]
        self.seconds = np.zeros(len(self.qids))

    def scan(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        codes = _Codes(ids, vectors, self.queries[0], self.k) if self.queries and self.distances is _table_sums else None
        for j in range(0, len(ids) if codes is None else 1, ROWS_AT_ONCE):
            some, own = (vectors[j : j + ROWS_AT_ONCE], ids[j : j + ROWS_AT_ONCE]) if codes is None else (None, ids)
            for q, query in enumerate(self.queries):
                began = time.perf_counter()
                d, i = self.best[q]
                # What is farther than the k-th so far, by more than rounding, is left out.
                most = d[-1] + 2 * 10.0**-DIGITS + 1e-12 * abs(d[-1]) if len(d) == self.k else np.inf
                if codes is None:
                    found = self.distances(some, query)
                    few = np.flatnonzero(~(found > most))
                    found, near = found[few], own[few]
                else:
                    found, near = codes.near(query, most)
                if len(found):
                    d, i = np.concatenate([d, np.round(found, DIGITS)]), np.concatenate([i, near])
                    at = nearest_rows(d, i, self.k)
                    self.best[q] = d[at], i[at]
                self.seconds[q] += time.perf_counter() - began

    def table(self) -> pa.Table:
        """NEAR rows; a query's seconds stand at its first row here."""
        n = np.array([len(d) for d, _ in self.best], np.int64)
        seconds = np.zeros(int(n.sum()))
        seconds[(np.cumsum(n) - n)[n > 0]] = self.seconds[n > 0]
        dist, ids = (np.concatenate([empty, *(b[j] for b in self.best)]) for j, empty in ((0, np.zeros(0)), (1, np.zeros(0, np.int64))))
        return pa.table({"qid": pa.array(np.repeat(self.qids, n), pa.int64()), "vec_id": pa.array(ids), "dist": pa.array(dist), "seconds": pa.array(seconds)})


def _scan(rows: DataFrame, queries: DataFrame, bytes_each: int, k: int, prepared: Callable[[pa.Table], list], distances: Callable[[np.ndarray, object], np.ndarray], timed: bool) -> DataFrame:
    """The k nearest rows (vec_id, vector) per query: a block's queries are prepared once, a batch's vectors once a block."""
    column, size = rows.columns[1], queries.count() * bytes_each
    if size > BLOCK_BYTES:
        return top_k(_blocked(rows, queries, -(-size // BLOCK_BYTES), k, prepared, distances), k, timed)
    sent = rows.sparkSession.sparkContext.broadcast(queries.toArrow())  # of a size that was checked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(sent.value, k, prepared, distances)
        for batch in _joined(batches, CODES_AT_ONCE if distances is _table_sums else 1):
            best.scan(batch["vec_id"].cast(pa.int64()).to_numpy(), _matrix(batch[column]))
        yield from best.table().to_batches()

    # Rows are few beside the pairs: dealt out, every core scans a share, however few files or row groups hold them.
    return top_k(rows.repartition(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, NEAR), k, timed)


def _blocked(rows: DataFrame, queries: DataFrame, query_blocks: int, k: int, prepared: Callable[[pa.Table], list], distances: Callable[[np.ndarray, object], np.ndarray]) -> DataFrame:
    """NEAR rows of each pair of a query block and a row block, of which every row is in one."""
    column = rows.columns[1]
    n, width = rows.agg(F.count("*"), F.max(F.size(column))).first()
    row_blocks = max(1, -(-n * (8 * (width or 1) + 16) // ROW_BLOCK_BYTES))
    each = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    deal = lambda blocks: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))
    left = rows.withColumn("r", deal(row_blocks)).withColumn("b", each(query_blocks))
    # Queries often are some of the rows: under other names, their columns are no longer those of the rows.
    names = queries.columns
    right = queries.select(*[F.col(c).alias(f"asked_{c}") for c in names]).withColumn("b", deal(query_blocks)).withColumn("r", each(row_blocks))

    def cell(some: pa.Table, asked: pa.Table) -> pa.Table:
        if not some.num_rows or not asked.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "dist": pa.array([], pa.float64()), "seconds": pa.array([], pa.float64())})
        asked = asked.select([f"asked_{c}" for c in names]).rename_columns(names)
        best = _Best(asked, k, prepared, distances)
        for batch in _joined(some.to_batches(max_chunksize=10_000), CODES_AT_ONCE if distances is _table_sums else 1):
            best.scan(batch["vec_id"].cast(pa.int64()).to_numpy(), _matrix(batch[column]))
        return best.table()

    return left.groupBy("r", "b").cogroup(right.groupBy("r", "b")).applyInArrow(cell, NEAR)


def top_k(distances: DataFrame, k: int, timed: bool = False) -> DataFrame:
    """(qid, rank from 1, vec_id, dist) of the k nearest per query; `timed`: also the sum of a query's seconds."""
    whole = Window.partitionBy("qid")
    if timed:
        distances = distances.withColumn("seconds", F.sum("seconds").over(whole))
    ranked = distances.withColumn("rank", F.row_number().over(whole.orderBy("dist", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("qid", "rank", "vec_id", "dist", *["seconds"] * timed)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(values)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _joined(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches, put together until they have so many rows."""
    some: list[pa.RecordBatch] = []
    for batch in batches:
        some += [batch] * (batch.num_rows > 0)
        if sum(b.num_rows for b in some) >= rows:
            yield pa.Table.from_batches(some)
            some = []
    if some:
        yield pa.Table.from_batches(some)


def _lut(table: pa.Table) -> list[list[np.ndarray]]:
    return [[np.asarray(row, float) for row in lut] for lut in table["lut"].to_pylist()]


def _table_sums(codes: np.ndarray, lut: list[np.ndarray]) -> np.ndarray:
    total = np.zeros(len(codes))
    for m, row in enumerate(lut):
        total += row[codes[:, m]]
    return total


class _Codes:
    """Codes of some rows: equal ones stand once, with the k smallest ids, since ties go to those; some subspaces' tables are looked up together."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, lut: list[np.ndarray], k: int):
        sizes = [len(row) for row in lut]
        codes = codes[:, : len(sizes)]
        if codes.shape[1] < len(sizes) or len(codes) and ((codes < 0) | (codes >= np.array(sizes))).any():
            raise IndexError("a code is outside its lookup table")
        order = np.argsort(ids, kind="stable")
        ids, codes, self.k = ids[order], codes[order], k
        if np.prod(np.array(sizes, float)) < 2.0**62:
            key = np.zeros(len(codes), np.int64)
            for m, n in enumerate(sizes):
                key = key * n + codes[:, m]
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            self.count = np.minimum(np.diff(np.append(first, len(key))), k)
            self.ids, self.first, self.codes = ids[order], first, codes[order[first]]
        else:
            self.ids, self.first, self.count, self.codes = ids, np.arange(len(ids)), np.ones(len(ids), np.int64), codes
        self.groups, at = [], 0
        while at < len(sizes):
            end, n = at + 1, sizes[at]
            while end < len(sizes) and n * sizes[end] <= min(JOINT_ENTRIES, max(1, len(self.codes))):
                n, end = n * sizes[end], end + 1
            joint = np.zeros(len(self.codes), np.intp)
            for m in range(at, end):
                joint = joint * sizes[m] + self.codes[:, m]
            self.groups.append((at, end, joint))
            at = end

    def near(self, lut: list[np.ndarray], most: float) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of all rows at most so far, or of the k nearest at least, by sums in the order of the subspaces."""
        total, scale = None, 0.0
        for at, end, joint in self.groups:
            table = lut[at]
            for m in range(at + 1, end):
                table = np.add.outer(table, lut[m]).ravel()
            scale += np.abs(table).max()
            total = table.astype(np.float32)[joint] if total is None else total + table.astype(np.float32)[joint]
        slack = 1e-6 * (len(self.groups) + 1) * scale
        if len(total) > self.k:
            most = min(most, float(np.partition(total, self.k - 1)[self.k - 1]) + slack) if not np.isfinite(most) else most
        few = np.flatnonzero(~(total > most + slack)) if len(total) else np.zeros(0, np.int64)
        exact, n = _table_sums(self.codes[few], lut), self.count[few]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[few], n)
        return np.repeat(exact, n), self.ids[place]


def adc_topk(codes: DataFrame, tables: DataFrame, k: int, timed: bool = False) -> DataFrame:
    """The k nearest codes (vec_id, codes) per query by sums of lookup-table entries (qid, lut)."""
    width = tables.select(F.aggregate("lut", F.lit(0), lambda acc, r: acc + F.size(r)).alias("n")).agg(F.max("n")).first()[0] or 1
    return _scan(codes.select("vec_id", "codes"), tables, 8 * width, k, _lut, _table_sums, timed)


def adc_long(codes: DataFrame, tables: DataFrame, k: int) -> DataFrame:
    """The same from long codes (vec_id, m, k) and tables (qid, m, k, d).

    Where all queries have a distance for the same pairs (m, k), codes become places in the list of these and are scanned;
    other tables are joined and summed, with a row for each code and query.
    """
    each = tables.groupBy("qid").agg(F.count("d").alias("n"), F.count("*").alias("rows"), F.count_distinct("m", "k").alias("pairs"))
    low, high = each.agg(F.min(F.least("n", "pairs")), F.max("rows")).first()
    if high is not None and low == high <= MOST_PAIRS:
        known = tables.select("m", "k").distinct()
        pairs = sorted(tuple(r) for r in known.limit(high + 1).collect())
        if len(pairs) == high:
            places = F.broadcast(codes.sparkSession.createDataFrame([(*p, at) for at, p in enumerate(pairs)], known.schema.add("at", IntegerType(), False)))
            lists = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda e: e[c])
            rows = cut(codes.join(places, ["m", "k"]).select("vec_id", F.col("at").alias("code"), "at").groupBy("vec_id").agg(lists("code").alias("codes")))
            parts = rows.agg(F.max(F.size("codes"))).first()[0] or 1
            padded = rows.select("vec_id", F.concat("codes", F.array_repeat(F.lit(high), F.lit(parts) - F.size("codes"))).alias("codes"))
            # One row of distances a query, looked up for each of a vector's codes; what pads a list adds nothing.
            asked = tables.join(places, ["m", "k"]).groupBy("qid").agg(F.concat(lists("d"), F.array(F.lit(0.0))).alias("row"))
            return _scan(padded, asked, 8 * (high + 1), k, lambda table: [[np.asarray(row, float)] * parts for row in table["row"].to_pylist()], _table_sums, False)
    total = codes.join(tables, ["m", "k"]).groupBy("qid", "vec_id").agg(F.round(F.sum("d"), DIGITS).alias("dist"))
    return top_k(total, k)


def _differences(codes: np.ndarray, query: np.ndarray) -> np.ndarray:
    return (codes != query).sum(1).astype(float)


def hamming_topk(codes: DataFrame, query_codes: DataFrame, k: int, timed: bool = False) -> DataFrame:
    """The k codes that differ least from each query's (qid, codes)."""
    width = query_codes.agg(F.max(F.size("codes"))).first()[0] or 1
    return _scan(codes.select("vec_id", "codes"), query_codes, 8 * width, k, lambda table: list(_matrix(table["codes"])), _differences, timed)


def _square_distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    return ((rows.astype(np.float64) - query.astype(np.float64)) ** 2).sum(1)


def _binary_jaccard(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    both, either = ((rows != 0) & (query != 0)).sum(1), ((rows != 0) | (query != 0)).sum(1)
    return np.where(either == 0, 1.0, 1 - both / np.maximum(either, 1))


def _shares(rows: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(rows, query).sum(1, dtype=float), np.maximum(rows, query).sum(1, dtype=float)


def _general_jaccard(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    low, high = _shares(rows, query)
    return 1 - low / (high + EPS)


def _weighted_jaccard(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    low, high = _shares(rows, query)
    return np.where(high == 0, 0.0, 1 - low / np.where(high == 0, 1, high))


#: Distances of the rows of a matrix to a query.
EXACT: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "l2sq": _square_distances,
    "l2": lambda rows, query: np.sqrt(_square_distances(rows, query)),
    "jaccard": _binary_jaccard,
    "jaccard0": lambda rows, query: np.where((rows != 0).any(1) | (query != 0).any(), _binary_jaccard(rows, query), 0.0),
    "weighted_jaccard": _weighted_jaccard,
    "gjaccard": _general_jaccard,
    "hamming": _differences,
}


def of_rows(distance: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Marks a user's metric that takes a matrix and one vector, and returns the distances of all rows: no call of Python for each pair."""
    distance.of_rows = True
    return distance


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, by: str | Callable[[np.ndarray, np.ndarray], float | np.ndarray] = "l2sq", timed: bool = False) -> DataFrame:
    """The k nearest of (vec_id, embedding) to each of (qid, embedding), by full scan under a metric of EXACT, a function of two arrays, or one marked by `of_rows`."""
    if not callable(by) and by not in EXACT:
        raise ValueError(f"unknown metric {by!r}; known: {', '.join(EXACT)}")
    distances = EXACT[by] if not callable(by) else by if getattr(by, "of_rows", False) else lambda rows, query: np.array([float(by(row, query)) for row in rows])
    width = queries.agg(F.max(F.size("embedding"))).first()[0] or 1
    return _scan(vectors.select("vec_id", "embedding"), queries, 8 * width, k, lambda table: list(_matrix(table["embedding"])), distances, timed)
