"""Product quantization: codebooks, assignment, Lloyd steps, packed codes.

Tables are long: subvectors (vec_id, m, sv), codebooks (m, k, centroid), codes
(vec_id, m, k).  All subspaces train in one job keyed by m.  Assignment compares
Arrow batches of subvectors with a subspace's centroids, so it neither multiplies
rows nor shuffles while the codebook is small enough to broadcast.  `encode` makes all codes of a
vector where it is read: nothing is shuffled there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.metrics import ROW_METRICS, Metric, l2_squared, metric
from ..functions.vectors import subvectors, width
from .lineage import cut

#: A user's centroid: from the column of a cluster's subvectors to an aggregate of it.
Aggregate = Callable[[Column], Column]

#: Bytes of a codebook up to which it is broadcast; larger ones are joined on m.
BROADCAST_BYTES = 64 << 20
#: Of a k-means|| start: rounds of draws, and steps of the clustering of what they drew.
ROUNDS, RECLUSTER_STEPS = 5, 5


def distinct_subvectors(sub: DataFrame) -> DataFrame:
    """(m, sv, n): the subvectors of each subspace with how often they occur."""
    return sub.groupBy("m", "sv").agg(F.count("*").alias("n"))


def _least(ks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first ks distinct subvectors of each subspace among a task's rows (m, sv)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch["m"].to_numpy()
            sv = batch["sv"].flatten().to_numpy(zero_copy_only=False).reshape(len(m), -1)
            for k in np.unique(m).tolist():
                found = sv[m == k] if k not in best else np.vstack([best[k], sv[m == k]])
                best[k] = np.unique(found, axis=0)[:ks]
        for k, rows in best.items():
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(rows), pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))], names=["m", "sv"])

    return run


def first_centroids(sub: DataFrame, ks: int) -> DataFrame:
    """The first ks distinct subvectors in lexicographic order; fewer where a subspace has fewer.

    Each task keeps its own first ks a subspace, so that only those are shuffled and ranked.
    """
    order = Window.partitionBy("m").orderBy("sv")
    few = sub.select(F.col("m").cast("int").alias("m"), "sv").mapInArrow(_least(ks), "m int, sv array<double>").distinct()
    return few.withColumn("k", F.row_number().over(order) - 1).where(F.col("k") < ks).select("m", "k", F.col("sv").alias("centroid"))


def spread_centroids(sub: DataFrame, ks: int, seed: int = 0, by: str | Metric = "l2sq", parts: int | None = None) -> DataFrame:
    """k-means++ start: each next centroid is drawn with probability proportional to its squared distance.

    With another metric than "l2sq" its value is squared: the start of k-medoids++.

    One weighted draw per step and subspace, by the largest log(u) / weight with hash-seeded u: `ks` steps one after
    the other, for which parallel_centroids needs a few. With `parts`, subspaces m + r parts draw like subspace m
    under the seed `seed` + ks r.
    """
    own, restart = (F.col("m"), F.lit(0)) if parts is None else ((F.col("m") % parts).cast("int"), F.floor(F.col("m") / parts))
    points = cut(distinct_subvectors(sub))
    distance = metric(by)
    squared = distance if by == "l2sq" else lambda a, b: distance(a, b) * distance(a, b)
    chosen = None
    for step in range(ks):
        u = (F.pmod(F.xxhash64(own, "sv", (restart * ks + seed + step).cast("int")), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
        if chosen is None:
            weighed = points.withColumn("w", F.col("n").cast("double"))
        else:
            books = _book(chosen)
            near = lambda c: squared(F.col("sv"), c["centroid"])
            small = book_bytes(chosen) <= BROADCAST_BYTES
            weighed = points.join(F.broadcast(books) if small else books, "m").withColumn("w", F.col("n") * F.array_min(F.transform("book", near))).drop("book")
        drawn = weighed.where("w > 0").groupBy("m").agg(F.max_by("sv", F.struct(F.log(u) / F.col("w"), "sv")).alias("centroid"))
        drawn = drawn.select("m", F.lit(step).alias("k"), "centroid")
        chosen = cut(drawn if chosen is None else chosen.unionByName(drawn))
    return chosen


def oversampled(sub: DataFrame, ks: int, seed: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """(m, c, sv, weight): candidates for centroids of each subspace, c their smallest vec_id, weight the vectors nearest to them.

    The first is one distinct subvector a subspace, the one of least draw. In each of `rounds` rounds every subvector
    becomes a candidate with probability 2 ks times its share of the summed squared distances to the candidates so
    far; about 2 ks a round do, whatever the data. A round measures the new candidates only, and keeps the
    nearest so far. Draws are hashes of seed, round, subspace and vec_id. Ties go to the smallest c.
    """
    points = cut(sub.groupBy("m", "sv").agg(F.count("*").alias("n"), F.min("vec_id").alias("c")))
    draw = lambda r: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(r)), "m", "c").cast("binary")), 1, 8), 16, 10).cast("double") + 1) / float(1 << 32)
    new = cut(points.groupBy("m").agg(F.min_by(F.struct("c", "sv"), F.struct(draw(0), "c")).alias("first")).select("m", "first.c", "first.sv"))
    found, near = new, None
    for r in range(1, rounds + 2):
        # Centroids of a block are few beside the subvectors, which are only read.
        least = assign(points, new.select("m", F.col("c").alias("k"), F.col("sv").alias("centroid"))) if near is None else _nearer(near, new)
        near = cut(least.select("m", "sv", "n", "c", F.col("k").alias("at"), "d"))
        if r > rounds:
            break
        total = near.groupBy("m").agg(F.sum(F.col("n") * F.col("d")).alias("total"))
        chance = 2.0 * ks * F.col("n") * F.col("d") / F.col("total")
        new = cut(near.join(F.broadcast(total), "m").where((F.col("total") > 0) & (draw(r) < chance)).select("m", "c", "sv"))
        found = found.unionByName(new)
    weights = near.groupBy("m", F.col("at").alias("c")).agg(F.sum("n").alias("weight"))
    return found.join(weights, ["m", "c"])


def _nearer(near: DataFrame, new: DataFrame) -> DataFrame:
    """near (m, sv, n, c, at, d) as (..., k, d) with the new candidates where they are nearer."""
    book = _book(new.select("m", F.col("c").alias("k"), F.col("sv").alias("centroid")))
    to = lambda x: F.struct(l2_squared(F.col("sv"), x["centroid"]).alias("d"), x["k"].alias("k"))
    joined = near.join(F.broadcast(book) if book_bytes(new.withColumnRenamed("sv", "centroid")) <= BROADCAST_BYTES else book, "m", "left")
    best = F.least(F.struct("d", F.col("at").alias("k")), F.array_min(F.transform("book", to)))
    return joined.withColumn("best", best).select("m", "sv", "n", "c", F.col("best.k").alias("k"), F.col("best.d").alias("d"))


def _reclustered(ks: int, seed: int) -> Callable[[pa.Table], pa.Table]:
    """At most ks centroids from the weighted candidates of one subspace: drawn by squared distance, then a few weighted means."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("c").combine_chunks()
        m, w = rows["m"][0].as_py(), rows["weight"].to_numpy().astype(float)
        x = rows["sv"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(w), -1)
        rng = np.random.default_rng([seed, m])
        chosen = [int(rng.choice(len(x), p=w / w.sum()))]
        far = ((x - x[chosen[0]]) ** 2).sum(1)
        while len(chosen) < ks and (far * w).max() > 0:
            chosen.append(int(rng.choice(len(x), p=far * w / (far * w).sum())))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
        c = x[chosen].copy()
        for _ in range(RECLUSTER_STEPS):
            square = (c * c).sum(1)
            near = np.concatenate([(square - 2 * x[i : i + 1024] @ c.T).argmin(1) for i in range(0, len(x), 1024)])
            total = np.bincount(near, w, len(c))
            for j in range(x.shape[1]):
                c[:, j] = np.where(total > 0, np.bincount(near, w * x[:, j], len(c)) / np.where(total > 0, total, 1), c[:, j])
        c = np.unique(c, axis=0)
        return pa.table({"m": pa.array([m] * len(c), pa.int32()), "k": pa.array(range(len(c)), pa.int32()), "centroid": pa.array(list(c), pa.list_(pa.float64()))})

    return run


def parallel_centroids(sub: DataFrame, ks: int, seed: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """k-means|| start: `rounds` rounds of oversampling, whatever ks, then the candidates of a subspace, about 2 ks x rounds, clustered in one task."""
    candidates = oversampled(sub, ks, seed, rounds).select(F.col("m").cast("int").alias("m"), "c", "sv", F.col("weight").cast("double").alias("weight"))
    return cut(candidates.groupBy("m").applyInArrow(_reclustered(ks, seed), "m int, k int, centroid array<double>"))


def _book(codebook: DataFrame) -> DataFrame:
    return codebook.groupBy("m").agg(F.array_sort(F.collect_list(F.struct("k", "centroid"))).alias("book"))


def book_bytes(codebook: DataFrame) -> int:
    return codebook.agg(F.sum(F.size("centroid") * 8 + 16)).first()[0] or 0


def sent_book(codebook: DataFrame) -> Broadcast:
    """{m: (centroids, numbers by k)} of a codebook of a size that was checked."""
    rows = codebook.select("m", "k", "centroid").toArrow().sort_by([("m", "ascending"), ("k", "ascending")]).combine_chunks()
    m, book = rows["m"].to_numpy(), {}
    for p in np.unique(m).tolist():  # widths may differ from subspace to subspace
        own = rows.filter(pa.array(m == p))
        book[p] = own["centroid"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1), own["k"].to_numpy()
    return codebook.sparkSession.sparkContext.broadcast(book)


def nearest_centroids(x: np.ndarray, centroids: np.ndarray, by: str, ties_high: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of the nearest centroid of each row, some rows at a time."""
    at, d = np.zeros(len(x), np.int64), np.zeros(len(x))
    step = max(1, (1 << 20) // max(1, len(centroids)))
    for i in range(0, len(x), step):
        found = ROW_METRICS[by](x[i : i + step], centroids)
        best = len(centroids) - 1 - found[:, ::-1].argmin(1) if ties_high else found.argmin(1)
        at[i : i + step], d[i : i + step] = best, found[np.arange(len(best)), best]
    return at, d


def assign(sub: DataFrame, codebook: DataFrame, by: str | Metric = "l2sq", ties_high: bool = False) -> DataFrame:
    """sub (..., m, sv) with k and d, the nearest centroid and its distance; ties go to the lowest k (or the highest).

    With a codebook of up to BROADCAST_BYTES and a metric of ROW_METRICS this is a map over Arrow batches;
    otherwise centroids are joined on m and folded inside each row. Subvectors of a subspace without centroids go.
    """
    names = [c for c in sub.columns if c not in ("k", "d")]
    if by in ROW_METRICS and book_bytes(codebook) <= BROADCAST_BYTES:
        sent = sent_book(codebook)
        number = codebook.schema["k"].dataType
        schema, kind = StructType([*[sub.schema[c] for c in names], StructField("k", number), StructField("d", DoubleType())]), to_arrow_type(number)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m, k, d = batch["m"].to_numpy(), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
                for p in np.unique(m).tolist():
                    own = np.flatnonzero(m == p)
                    if p in sent.value:
                        centroids, numbers = sent.value[p]
                        x = batch["sv"].take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), -1)
                        if x.shape[1] != centroids.shape[1]:
                            raise ValueError(f"subvectors of {x.shape[1]} entries, centroids of {centroids.shape[1]}")
                        at, d[own] = nearest_centroids(x, centroids, by, ties_high)
                        k[own] = numbers[at]
                columns = [*[batch[c] for c in names], pa.array(k).cast(kind), pa.array(d)]
                out = pa.RecordBatch.from_arrays(columns, names=[*names, "k", "d"])
                yield out.filter(pa.array(np.isin(m, list(sent.value))))

        return sub.select(*names).mapInArrow(run, schema)
    distance = metric(by)
    sign = -1 if ties_high else 1

    def candidate(c: Column) -> Column:
        return F.struct(distance(F.col("sv"), c["centroid"]).alias("d"), (c["k"] * sign).alias("k"))

    book = _book(codebook)
    found = sub.select(*names).join(F.broadcast(book) if book_bytes(codebook) <= BROADCAST_BYTES else book, "m").withColumn("best", F.array_min(F.transform("book", candidate)))
    return found.withColumns({"k": F.col("best.k") * sign, "d": F.col("best.d")}).select(*names, "k", "d")


def updated_centroids(assigned: DataFrame, codebook: DataFrame, empty: str = "keep", weight: str | None = None, centroid: Aggregate | None = None) -> DataFrame:
    """Means of the subvectors of each centroid (m, k, centroid), or what `centroid` makes of the column of its subvectors.

    `centroid` is an aggregate of built-in functions or a grouped-aggregate Pandas UDF, without weights. A centroid without subvectors stays (`keep`), becomes zeros (`zeros`) or the
    subvector farthest from its own centroid (`farthest`, ties by vec_id).
    """
    if centroid and weight:
        raise ValueError("a user centroid takes no weights")
    w = F.col(weight) if weight else F.lit(1.0)
    first = codebook.select(F.size("centroid")).first()
    n = first[0] if first else 0
    # One row a centroid and task is shuffled: sums of each entry, and the weight.
    sums = assigned.select("m", "k", w.alias("w"), "sv").groupBy("m", "k").agg(F.sum("w").alias("w"), *[F.sum(F.get("sv", F.lit(j)) * F.col("w")).alias(f"x{j}") for j in range(n)])
    means = sums.select("m", "k", F.array(*[F.col(f"x{j}") / F.col("w") for j in range(n)]).alias("mean"))
    if centroid:
        means = assigned.groupBy("m", "k").agg(centroid(F.col("sv")).alias("mean"))
    joined = codebook.join(means, ["m", "k"], "left")
    if empty == "zeros":
        fallback = F.transform("centroid", lambda x: F.lit(0.0))
    elif empty == "farthest":
        far = assigned.groupBy("m").agg(F.max_by("sv", F.struct("d", -F.col("vec_id"))).alias("far"))
        joined, fallback = joined.join(far, "m", "left"), F.coalesce("far", "centroid")
    elif empty == "keep":
        fallback = F.col("centroid")
    else:
        raise ValueError(f"unknown rule for empty clusters: {empty!r}")
    return joined.select("m", "k", F.coalesce("mean", fallback).alias("centroid"))


def lloyd(sub: DataFrame, codebook: DataFrame, steps: int, by: str | Metric = "l2sq", empty: str = "keep") -> DataFrame:
    """The codebook after a fixed number of steps."""
    for _ in range(steps):
        codebook = cut(updated_centroids(assign(sub, codebook, by), codebook, empty))
    return codebook


@dataclass
class Training:
    codebook: DataFrame
    codes: DataFrame
    steps: int
    converged: bool


#: Steps with the same number of changes after which a training with a limit of steps stops, and that limit in models.
SAME_CHANGES, MAX_STEPS = 20, 500
#: Bytes of a codebook whose sums a task may return to the driver, of the subvectors near a border that all tasks return, and of subvectors in a block.
PASS_BYTES, BORDER_BYTES, PACK_BYTES = 1 << 20, 16 << 20, 1 << 20
PASS = "task int, m int, sums binary, counts binary, changes long, limit double, xs binary, ks binary, gaps binary"


def numbered_steps(most: int | None) -> Iterable[int]:
    """1, 2, ... up to the limit, or without end."""
    return count(1) if most is None else range(1, most + 1)


def _packed_blocks(sub: DataFrame) -> DataFrame:
    """(m, n, xs): subvectors as the bytes of a matrix, written once and read by every step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, lists = batch["m"].to_numpy(), batch["sv"]
            for p in np.unique(m).tolist():
                own = np.flatnonzero(m == p)
                x = lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), -1)
                step = max(1, PACK_BYTES // max(8, 8 * x.shape[1]))
                for i in range(0, len(x), step):
                    part = x[i : i + step]
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([len(part)], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["m", "n", "xs"])

    # Dealt out, so that a pass has work for all cores even where the input is one file.
    dealt = sub.select(F.col("m").cast("int").alias("m"), F.transform("sv", lambda x: x.cast("double")).alias("sv")).repartition(sub.sparkSession.sparkContext.defaultParallelism)
    return cut(dealt.mapInArrow(run, "m int, n int, xs binary"))


def nearest_two(x: np.ndarray, c: np.ndarray, by: str) -> tuple[np.ndarray, np.ndarray]:
    """(place of the nearest centroid, how much farther the second is) under a Euclidean metric; what rounding might turn is measured as `nearest_centroids` does."""
    square, own = (c * c).sum(1), (x * x).sum(1)
    if len(c) == 1:
        return np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    found = x @ (-2 * c.T)
    found += square
    rows, at = np.arange(len(x)), found.argmin(1)
    first = found[rows, at]
    found[rows, at] = np.inf
    second = found.min(1)
    sure = 1e-10 * (own + square.max() + 1e-300)
    close = np.flatnonzero(~(second - first > sure))
    if len(close):
        at[close] = nearest_centroids(x[close], c, by)[0]
    gap = (second - first) / (np.sqrt(np.maximum(first + own, 0)) + np.sqrt(np.maximum(second + own, 0)) + 1e-300)
    gap[close] = 0.0
    return at, gap


def lloyd_pass(blocks: DataFrame, book: dict[int, tuple[np.ndarray, np.ndarray]], before: dict[int, tuple[np.ndarray, np.ndarray]] | None, by: str, most: int) -> pa.Table:
    """PASS rows: per task and subspace the sums and counts of each centroid's subvectors, how many were nearest to another one `before`,

    and the `most` subvectors whose nearest two centroids are about as near, with that gap; all others have a gap of `limit` at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state: dict[int, list] = {}
        for batch in batches:
            for p, n, xs in zip(batch["m"].to_pylist(), batch["n"].to_pylist(), batch["xs"], strict=True):
                if p not in book:
                    continue
                c = book[p][0]
                x = np.frombuffer(xs.as_buffer(), np.float64).reshape(n, -1)
                if x.shape[1] != c.shape[1]:
                    raise ValueError(f"subvectors of {x.shape[1]} entries, centroids of {c.shape[1]}")
                at, gap = nearest_two(x, c, by)
                if p not in state:
                    state[p] = [np.zeros(c.shape), np.zeros(len(c), np.int64), 0, np.inf, np.zeros((0, c.shape[1])), np.zeros(0, np.int64), np.zeros(0)]
                own = state[p]
                own[0] += np.stack([np.bincount(at, x[:, j], len(c)) for j in range(x.shape[1])], 1)
                own[1] += np.bincount(at, minlength=len(c))
                if before is not None:
                    own[2] += int((nearest_two(x, before[p][0], by)[0] != at).sum())
                few = np.flatnonzero(gap < own[3])
                xs_, ks_, gaps = np.concatenate([own[4], x[few]]), np.concatenate([own[5], at[few]]), np.concatenate([own[6], gap[few]])
                if len(gaps) > most:
                    order = np.argsort(gaps, kind="stable")
                    own[3] = float(gaps[order[most]])
                    xs_, ks_, gaps = xs_[order[:most]], ks_[order[:most]], gaps[order[:most]]
                own[4:] = xs_, ks_, gaps
        task = TaskContext.get().partitionId()
        for p, (sums, counts, changes, limit, xs_, ks_, gaps) in state.items():
            yield pa.RecordBatch.from_pylist([{"task": task, "m": p, "sums": sums.tobytes(), "counts": counts.tobytes(), "changes": changes, "limit": limit, "xs": xs_.tobytes(), "ks": ks_.tobytes(), "gaps": gaps.tobytes()}], schema=kind)

    kind = pa.schema([("task", pa.int32()), ("m", pa.int32()), ("sums", pa.binary()), ("counts", pa.binary()), ("changes", pa.int64()), ("limit", pa.float64()), ("xs", pa.binary()), ("ks", pa.binary()), ("gaps", pa.binary())])
    return blocks.mapInArrow(run, PASS).toArrow().sort_by([("m", "ascending"), ("task", "ascending")])


class _Border:
    """One subspace between two passes: sums under the pass's codebook, and the subvectors near a border of its cells, by gap."""

    def __init__(self, rows: list[dict], centroids: np.ndarray):
        shape = centroids.shape
        self.start, self.sums = centroids, sum((np.frombuffer(r["sums"]).reshape(shape) for r in rows), np.zeros(shape))
        self.counts = sum((np.frombuffer(r["counts"], np.int64) for r in rows), np.zeros(len(centroids), np.int64))
        x = np.concatenate([np.zeros((0, shape[1])), *(np.frombuffer(r["xs"]).reshape(-1, shape[1]) for r in rows)])
        at, gap = (np.concatenate([np.zeros(0, t), *(np.frombuffer(r[c], t) for r in rows)]) for c, t in (("ks", np.int64), ("gaps", np.float64)))
        order = np.argsort(gap, kind="stable")
        self.x, self.at, self.gap = x[order], at[order], gap[order]
        self.now, self.limit = self.at.copy(), min((r["limit"] for r in rows), default=np.inf)

    def reach(self, c: np.ndarray) -> float:
        """A subvector with a larger gap is still nearest to its centroid if these are the centroids."""
        moved = np.sqrt(((c - self.start) ** 2).sum(1).max())
        return 2 * moved * (1 + 1e-9) + 1e-9 * (1e-3 + np.abs(c).max()) if moved else 0.0

    def assign(self, c: np.ndarray, by: str) -> tuple[int, np.ndarray, np.ndarray]:
        """(changes, sums, counts) under centroids whose reach is below the limit."""
        n = int(np.searchsorted(self.gap, self.reach(c), "right"))
        now = self.at.copy()
        now[:n] = nearest_two(self.x[:n], c, by)[0] if n else now[:n]
        changes, self.now = int((now != self.now).sum()), now
        moved = np.flatnonzero(now != self.at)
        sums, counts = self.sums.copy(), self.counts.copy()
        for at, sign in ((self.at[moved], -1), (now[moved], 1)):
            np.add.at(sums, at, sign * self.x[moved])
            np.add.at(counts, at, sign)
        return changes, sums, counts


def _farthest(sub: DataFrame, codebook: DataFrame, by: str) -> dict[int, np.ndarray]:
    far = assign(sub.select("vec_id", "m", "sv"), codebook, by).groupBy("m").agg(F.max_by("sv", F.struct("d", -F.col("vec_id"))).alias("far"))
    return {r.m: np.array(r.far, float) for r in far.collect()}  # one subvector a subspace


def _trained_in_passes(sub: DataFrame, codebook: DataFrame, by: str, max_steps: int | None, empty: str) -> Training:
    """Lloyd steps of `train`, several to a pass over the subvectors.

    A pass returns sums of each centroid and the subvectors nearest to a border between two, BORDER_BYTES at most of all. While no
    centroid has moved by half of what any other subvector would need to change, only those can: steps up to there are taken
    with them, and are the steps that passes would take. Where not even one is sure, each step is a pass of one job.
    """
    spark = sub.sparkSession
    blocks, schema = _packed_blocks(sub), codebook.schema
    rows = codebook.toArrow().sort_by([("m", "ascending"), ("k", "ascending")]).combine_chunks()  # of a size that was checked
    m = rows["m"].to_numpy()
    book = {}
    for p in np.unique(m).tolist():
        own = rows.filter(pa.array(m == p)).combine_chunks()
        book[p] = own["centroid"].chunk(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(own.num_rows, -1), own["k"].to_numpy()
    each = sum(8 * c.shape[1] + 16 for c, _ in book.values()) * max(1, blocks.rdd.getNumPartitions())

    def frame() -> DataFrame:
        flat = [(p, int(k), c.tolist()) for p, (cs, ks) in book.items() for c, k in zip(cs, ks, strict=True)]
        return cut(spark.createDataFrame(flat, schema))

    before, border, last, same, seen = None, None, None, 0, set()
    for step in numbered_steps(max_steps):
        if border is None or any(b.reach(book[p][0]) >= b.limit for p, b in border.items()):
            table = lloyd_pass(blocks, book, before, by, BORDER_BYTES // each)
            found: dict[int, list] = {p: [] for p in book}
            for r in table.to_pylist():
                found[r["m"]].append(r)
            border = {p: _Border(rs, book[p][0]) for p, rs in found.items()}
            changes, made = sum(r["changes"] for rs in found.values() for r in rs), {p: (b.sums, b.counts) for p, b in border.items()}
        else:
            each_changes = {p: b.assign(book[p][0], by) for p, b in border.items()}
            changes, made = sum(c for c, _, _ in each_changes.values()), {p: (s, n) for p, (_, s, n) in each_changes.items()}
        if before is not None:
            same = same + 1 if changes == last else 0
            last = changes
            stuck = same >= SAME_CHANGES
            if max_steps is None:  # the same centroids again: a circle, without an end
                state = hashlib.sha256(b"".join(c.tobytes() for c, _ in book.values())).digest()
                stuck = state in seen
                seen.add(state)
            if changes == 0 or stuck:
                done = frame()
                return Training(done, cut(assign(sub, done, by)), step, changes == 0)
        far = _farthest(sub, frame(), by) if empty == "farthest" and any((n == 0).any() for _, n in made.values()) else {}
        before, book = book, {p: (_moved(c, *made[p], empty, far.get(p)), k) for p, (c, k) in book.items()}
    done = frame()
    return Training(done, assign(sub, done, by), max_steps, False)


def _moved(c: np.ndarray, sums: np.ndarray, counts: np.ndarray, empty: str, far: np.ndarray | None) -> np.ndarray:
    fallback = np.zeros_like(c) if empty == "zeros" else np.broadcast_to(far, c.shape) if far is not None else c
    return np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], fallback)


def train(sub: DataFrame, codebook: DataFrame, by: str | Metric = "l2sq", max_steps: int | None = None, empty: str = "farthest", centroid: Aggregate | None = None) -> Training:
    """Lloyd steps until no assignment changes, however many that takes, or until centroids come again.

    With max_steps they also end after so many, or where the changes stay equal SAME_CHANGES times more.

    Euclidean trainings of small codebooks take their steps as `_trained_in_passes` says; others write codes and centroids each step.
    """
    if by in ("l2sq", "l2") and centroid is None and empty in ("keep", "zeros", "farthest") and "vec_id" in sub.columns:
        codebook = cut(codebook.select("m", "k", "centroid"))
        if 0 < book_bytes(codebook) <= PASS_BYTES:
            return _trained_in_passes(sub, codebook, by, max_steps, empty)
    before, last, same, seen = None, None, 0, set()
    for step in numbered_steps(max_steps):
        codes = cut(assign(sub, codebook, by))
        if before is not None:
            moved = codes.select("vec_id", "m", "k").join(before.select("vec_id", "m", F.col("k").alias("was")), ["vec_id", "m"])
            changes = moved.where("k <> was").count()
            same = same + 1 if changes == last else 0
            last = changes
            stuck = same >= SAME_CHANGES
            if max_steps is None:
                state = codebook.agg(F.sum(F.xxhash64("m", "k", "centroid").cast("decimal(38, 0)"))).first()[0]
                stuck = state in seen
                seen.add(state)
            if changes == 0 or stuck:
                return Training(codebook, codes, step, changes == 0)
        before = codes
        codebook = cut(updated_centroids(codes, codebook, empty, centroid=centroid))
    return Training(codebook, assign(sub, codebook, by), max_steps, False)


def train_restarted(sub: DataFrame, ks: int, restarts: int = 10, seed: int = 42, max_steps: int | None = MAX_STEPS, empty: str = "farthest") -> Training:
    """The best of several k-means trainings: per subspace the codebook with the least summed squared distance (ties: the earliest).

    Each training starts from k-means++ centroids of its own seed, seed + ks r. All run as one: a restart's subspaces
    are subspaces of their own, so that the number of Spark jobs does not grow with the restarts.
    """
    if restarts < 1:
        raise ValueError(f"restarts must be at least 1, got {restarts}")
    parts = (sub.agg(F.max("m")).first()[0] or 0) + 1
    each = sub.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1)))).withColumn("m", (F.col("m") + F.col("r") * parts).cast("int")).drop("r")
    done = train(each, spread_centroids(each, ks, seed, parts=parts), "l2sq", max_steps, empty)
    real, restart = (F.col("m") % parts).cast("int"), F.floor(F.col("m") / parts).cast("int")
    totals = done.codes.groupBy("m").agg(F.sum("d").alias("total")).select(real.alias("m"), restart.alias("r"), "total")
    best = totals.groupBy("m").agg(F.min_by("r", F.struct(F.round("total", 9), "r")).alias("r"))
    book = cut(done.codebook.select(real.alias("m"), restart.alias("r"), "k", "centroid").join(best, ["m", "r"]).select("m", "k", "centroid"))
    return Training(book, assign(sub, book), done.steps, done.converged)


def packed_codes(codes: DataFrame, key: str = "vec_id") -> DataFrame:
    """(key, codes): the codes of each vector in the order of m."""
    return codes.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "k"))), lambda c: c["k"]).alias("codes"))


def encode(vectors: DataFrame, codebook: DataFrame, parts: int, dimension: int, by: str | Metric = "l2sq", vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, codes) of vectors: the nearest centroid of each subspace, ties to the lowest k.

    With a codebook of up to BROADCAST_BYTES and a metric of ROW_METRICS this is a map over the vectors;
    otherwise subvectors are assigned and put together again.
    """
    w = width(dimension, parts)
    if by not in ROW_METRICS or book_bytes(codebook) > BROADCAST_BYTES:
        return packed_codes(assign(subvectors(vectors, parts, dimension, vector, key), codebook, by), key)
    sent = sent_book(codebook)
    schema = vectors.select(key).schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n and (np.asarray(batch["v"].value_lengths()) != dimension).any():
                raise ValueError(f"a vector is not of dimension {dimension}")
            sv = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(n, dimension)
            codes = np.zeros((n, parts), np.int32)
            for p, (centroids, numbers) in sent.value.items():
                codes[:, p] = numbers[nearest_centroids(sv[:, p * w : (p + 1) * w], centroids, by)[0]]
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * parts)
            yield pa.RecordBatch.from_arrays([batch[key], pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))], names=[key, "codes"])

    return vectors.select(key, F.transform(vector, lambda x: x.cast("double")).alias("v")).mapInArrow(run, f"{schema}, codes array<int>")


def quantization_error(assigned: DataFrame) -> DataFrame:
    """(m, error): the mean distance to the assigned centroid."""
    return assigned.groupBy("m").agg(F.avg("d").alias("error"))


def kmeans(points: DataFrame, centers: DataFrame, max_steps: int | None = 1000, by: str | Metric = "l2", empty: str = "farthest", centroid: Aggregate | None = None) -> Training:
    """Clusters points (vec_id, point) from given centers (k, center); a null point has label -1 in `codes`."""
    sub = points.where("point is not null").select("vec_id", F.lit(0).alias("m"), F.transform("point", lambda x: x.cast("double")).alias("sv"))
    sizes = {r[0] for r in sub.select(F.size("sv")).union(centers.select(F.size("center"))).distinct().limit(2).collect()}
    if len(sizes) != 1:
        raise ValueError(f"points and centers must be non-empty and of one dimension, got {sorted(sizes)}")
    book = centers.select(F.lit(0).alias("m"), "k", F.transform("center", lambda x: x.cast("double")).alias("centroid"))
    done = train(sub, book, by, max_steps, empty, centroid)
    codes = points.select("vec_id").join(done.codes.select("vec_id", "k"), "vec_id", "left").withColumn("k", F.coalesce("k", F.lit(-1)))
    return Training(done.codebook, codes, done.steps, done.converged)
