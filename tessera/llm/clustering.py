"""Clusters of integer vectors around centroids, by Drake's adaptive bounds.

Each vector keeps the numbers of its nearest centroids in order, a lower bound of
its distance to each of them but the first, and one lower bound, the remainder,
for all others.  When centroids move, a bound falls by its centroid's move and the
remainder by the largest move.  A vector's exact distance to its own centroid then
tells how long a prefix of the order has to be measured again: the bounds behind
it certify the rest.  Where not even the remainder does, the vector is measured
against all centroids.  The number of bounds kept shrinks to what the round before
has needed, between K/4 and K/8 of K centroids.

Distances that decide are exact integers, and bounds are rounded down, so results
equal those of a plain search, ties included.  A round is one map over the table
of vectors and bounds, written to the shared folder for the next, and one
aggregation with at most a row a centroid and task: vectors are never shuffled.
The driver holds the centroids only.

Nulls and odd rows: vectors of another length, and null vectors or components,
NaN and infinities are left out; components beyond MOST in size are an error,
since their distances are no longs.  A null vec_id is kept and starts no
centroid before all others do.  Repeated rows count as often as they stand;
with fewer vectors than centroids there are as many centroids as vectors; an
empty table gives no rows.  Only vec_id and embedding are read, so clashing
names do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import remove, shared_dir, table
from .textkit import tidy

DIMENSION, SCALE = 64, 256
CENTROIDS, ROUNDS, SALT = 40, 5, "2:"
#: Largest size of a component: squared distances of 64 components stay below 2^63.
MOST = 1 << 27
#: Sizes up to which products of vectors are exact in doubles.
SMALL = 1 << 22
SLACK = 1e-12
STATE = "vec_id long, x array<int>, near array<int>, low array<double>, used int, distance long"


def integer_vectors(embeddings: DataFrame, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the usable vectors, x the floors of the scaled components."""
    finite = F.forall("embedding", lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    kept = embeddings.where((F.size("embedding") == dimension) & finite)
    value = lambda v: F.floor(v.cast("double") * scale)
    whole = lambda v: F.when(F.abs(v.cast("double") * scale) <= MOST, value(v)).otherwise(F.raise_error(F.lit(f"a component is beyond {MOST}, scaled"))).cast("int")
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("x"))


def first_centroids(vectors: DataFrame, k: int, salt: str = SALT) -> np.ndarray:
    """The k vectors with the smallest hashes of their ids, in that order (equal ids: by components)."""
    mark = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(mark.alias("mark"), "x").orderBy(F.col("mark").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= SMALL:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], 1)


def chosen_distances(x: np.ndarray, c: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to its own centroids c[near]."""
    return np.stack([((x - c[near[:, j]]) ** 2).sum(1) for j in range(near.shape[1])], 1)


def scanned(x: np.ndarray, c: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(near, low, distance) of rows measured against all centroids, of which `kept` are remembered."""
    d = distances(x, c)
    order = np.argsort(d, axis=1, kind="stable")[:, : kept + 1]
    ranked = np.take_along_axis(d, order, 1)
    low = np.full((len(x), kept), np.inf)
    low[:, : ranked.shape[1] - 1] = np.sqrt(ranked[:, 1:]) * (1 - SLACK)
    return order[:, :kept], low, ranked[:, 0]


def moved_bounds(near: np.ndarray, low: np.ndarray, moves: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds after the centroids' moves, cut to `kept`: what is no longer remembered joins the remainder."""
    fall = np.empty_like(low)
    fall[:, :-1], fall[:, -1] = moves[near[:, 1:]], moves.max()
    fallen = low - fall
    finite = np.isfinite(fallen)
    low = np.where(finite, fallen - SLACK * (np.abs(np.where(finite, low, 0)) + fall), fallen)
    low = np.hstack([low[:, : kept - 1], low[:, kept - 1 :].min(1, keepdims=True)])
    return near[:, :kept], low


def bounded(x: np.ndarray, c: np.ndarray, near: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(near, low, used, distance) of rows with bounds that hold; used is the number of bounds that did not certify their centroids."""
    kept = near.shape[1]
    near, low = near.copy(), low.copy()
    distance = chosen_distances(x, c, near[:, :1])[:, 0]
    reached = ~(low > np.sqrt(distance)[:, None] * (1 + SLACK))
    used = np.where(reached.any(1), kept - np.argmax(reached[:, ::-1], 1), 0)
    for p in range(1, kept):
        at = np.flatnonzero(used == p)
        if len(at):
            d = chosen_distances(x[at], c, near[at, : p + 1])
            order = np.lexsort((near[at, : p + 1], d), axis=1)
            d = np.take_along_axis(d, order, 1)
            near[at, : p + 1] = np.take_along_axis(near[at, : p + 1], order, 1)
            low[at, :p], distance[at] = np.sqrt(d[:, 1:]) * (1 - SLACK), d[:, 0]
    at = np.flatnonzero(used == kept)
    if len(at):
        near[at], low[at], distance[at] = scanned(x[at], c, kept)
    return near, low, used, distance


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()).cast(kind))


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def assigned(vectors: DataFrame, centroids: np.ndarray, kept: int, moves: np.ndarray | None = None) -> DataFrame:
    """STATE after one assignment: of vectors (vec_id, x), or of a former state and the moves since."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch["x"]).astype(np.int64)
            if moves is None:
                near, low, distance = scanned(x, centroids, kept)
                used = np.zeros(len(x), np.int64)
            else:
                near, low = moved_bounds(_rows(batch["near"]), _rows(batch["low"]), moves, kept)
                near, low, used, distance = bounded(x, centroids, near, low)
            columns = [batch["vec_id"], batch["x"], _lists(near, pa.int32()), _lists(low, pa.float64()), pa.array(used).cast(pa.int32()), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "x", "near", "low", "used", "distance"])

    return vectors.mapInArrow(run, STATE)


def floored_means(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The floors of the clusters' means, empty clusters as they were, and the most bounds that a vector has used."""
    n = centroids.shape[1]
    sums = state.groupBy(F.get("near", F.lit(0)).alias("k")).agg(F.count("*").alias("n"), F.max("used").alias("used"), F.array(*[F.sum(F.get("x", F.lit(j))) for j in range(n)]).alias("total"))
    new, used = centroids.copy(), 0
    for r in sums.collect():  # a row a centroid
        new[r.k], used = [t // r.n for t in r.total], max(used, r.used)
    return new, used


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, salt: str = SALT) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), centroids) after `rounds` rounds of assignment and means, and one more assignment."""
    spark = embeddings.sparkSession
    vectors = integer_vectors(embeddings, dimension, scale)
    centroids = first_centroids(vectors, k, salt)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids.reshape(0, dimension)
    kept, moves, before = min(len(centroids), max(1, k // 4)), None, None
    for step in range(rounds + 1):
        state, path = assigned(vectors, centroids, kept, moves), shared_dir(spark)
        if step == rounds:
            state = state.select("vec_id", F.get("near", F.lit(0)).alias("cluster"), "distance")
        state.write.parquet(path)
        if before is not None:
            remove(spark, before)
        vectors, before = spark.read.schema(state.schema).parquet(path), path
        if step < rounds:
            new, used = floored_means(vectors, centroids)
            moves = np.sqrt(((new - centroids).astype(float) ** 2).sum(1)) * (1 + SLACK)
            centroids = new
            if step:
                kept = min(kept, max(used + 1, k // 8, 1))
    return vectors, centroids


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    inertia = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # a row a centroid
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values] or [F.lit(None)]), F.col("cluster"))
    return found.select(
        "vec_id", "cluster", "distance", of([inertia.get(k, 0) for k in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(digests).cast("string").alias("centroid_sha256"),
    )


def _sql() -> str:
    """The same by a plain search each round."""
    square = "CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    parts = [
        f"e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        f" WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSION})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY mark) - 1 AS k, v AS c FROM (SELECT v, sha256('{SALT}' || vec_id) AS mark FROM e ORDER BY mark LIMIT {CENTROIDS}))",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min(d * {CENTROIDS} + k) AS best FROM (SELECT vec_id, v, k, {square} AS d FROM e, c{r}) GROUP BY vec_id)")
        if r < ROUNDS:
            each = f"SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT best % {CENTROIDS} AS k, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{r}) GROUP BY k, j"
            mean = f"SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM ({each}) GROUP BY k"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN ({mean}) m ON m.k = o.k)")
    return (
        f"WITH {', '.join(parts)}, f AS (SELECT vec_id, CAST(best % {CENTROIDS} AS INTEGER) AS cluster, best // {CENTROIDS} AS distance FROM a{ROUNDS})"
        " SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,"
        f" sha256(array_to_string(list_transform(c, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256 FROM f JOIN c{ROUNDS} ON k = cluster"
    )


OP11_SQL = _sql()
