"""Clustering around members: k-medoids in two forms, exact medoids, autoscaling, DBSCAN codebooks.

All work on distinct weighted subvectors, which on sparse rasters are few.
Medoids are found by bounds from the members measured so far, density
neighbourhoods by an index of prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import Metric, metric, set_metric
from .lineage import cut
from .neighbours import near_sets
from .quantize import BROADCAST_BYTES, assign, distinct_subvectors, numbered_steps, spread_centroids, updated_centroids

#: Metrics that keep the triangle inequality, of vectors without negative entries where they are Jaccard metrics.
TRIANGLE = ("l2", "hamming", "jaccard", "jaccard0", "gjaccard", "weighted_jaccard")
#: Members measured in the first round of a search for medoids, and in any; relative slack of bounds against rounding.
FIRST_PIVOTS, MOST_PIVOTS, SLACK = 8, 4096, 1e-8
#: Of bounds from counts: pairs of cells that a task counts at once, counts in a slice of a cluster's table, and members that meet a slice in a task.
PAIRS_AT_ONCE, SLICE_COUNTS, SHARD_MEMBERS = 1 << 21, 1 << 22, 1 << 18


def autoscale(sub: DataFrame) -> DataFrame:
    """Each column of each subspace to mean 0 and population deviation 1; constant columns become 0."""
    first = sub.select(F.size("sv")).first()
    n = first[0] if first else 0
    # Statistics of a subspace are one row, and subspaces are few: the vectors themselves are not shuffled.
    each = [f(F.get("sv", F.lit(j))).alias(f"{k}{j}") for j in range(n) for k, f in (("a", F.avg), ("s", F.stddev_pop))]
    stats = sub.groupBy("m").agg(F.count("*").alias("n"), *each)
    stats = stats.select("m", *[F.array(*[F.col(f"{k}{j}") for j in range(n)]).alias(k) for k in ("a", "s")])
    at = lambda x, j: F.when(F.get("s", j) == 0, 0.0).otherwise((x - F.get("a", j)) / F.get("s", j))
    return sub.join(F.broadcast(stats), "m").select("vec_id", "m", F.transform("sv", at).alias("sv"))


def random_start(sub: DataFrame, ks: int, seed: int = 0) -> DataFrame:
    """ks distinct subvectors per subspace in a hash order."""
    order = Window.partitionBy("m").orderBy(F.xxhash64("sv", F.lit(seed)), "sv")
    ranked = sub.select("m", "sv").distinct().withColumn("k", F.row_number().over(order) - 1)
    return ranked.where(F.col("k") < ks).select("m", "k", F.col("sv").alias("centroid"))


def snapped(assigned: DataFrame, centers: DataFrame, by: str | Metric = "l2") -> DataFrame:
    """For each center the member of its cluster nearest to it (ties: smallest vec_id), itself if it has none."""
    to = metric(by)(F.col("sv"), F.col("centroid"))
    near = assigned.drop("d").join(centers, ["m", "k"]).groupBy("m", "k").agg(F.min_by("sv", F.struct(to, "vec_id")).alias("member"))
    return centers.join(near, ["m", "k"], "left").select("m", "k", F.coalesce("member", "centroid").alias("centroid"))


def _all_pairs(members: DataFrame, to: Metric, skip_self: bool) -> DataFrame:
    """(m, k, sv, total) of every member, by all pairs of a cluster's distinct members."""
    a = members.select("m", "k", F.col("sv").alias("a"))
    b = members.select("m", "k", F.col("sv").alias("b"), F.col("n").alias("nb"))
    times = F.when(F.col("a") == F.col("b"), F.col("nb") - (1 if skip_self else 0)).otherwise(F.col("nb"))
    total = a.join(b, ["m", "k"]).groupBy("m", "k", "a").agg(F.sum(to(F.col("a"), F.col("b")) * times).alias("total"))
    return total.withColumnRenamed("a", "sv")


def _best(totals: DataFrame) -> DataFrame:
    return totals.groupBy("m", "k").agg(F.min_by("sv", F.struct(F.round("total", 9), "sv")).alias("centroid"), F.min(F.round("total", 9)).alias("best"))


def summed_medoids(members: DataFrame, by: str | Metric, skip_self: bool = True, sets: bool = False, first: int = FIRST_PIVOTS) -> DataFrame:
    """(m, k, centroid): the member with the least sum of distances to its cluster's members.

    members is (m, k, sv, n), distinct subvectors with their counts, or with `sets` sorted lists of cells; ties go to the
    lexicographically first. Under a metric of TRIANGLE, members are measured in rounds: those measured are pivots,
    and a member x of N in all has a sum of at least |N d(x, p) - sum(p)| for each pivot p. Members that cannot be
    the best go; of the rest those with the least bounds come next, in the first round `first` of each cluster, then as many as the square root of
    the most that are left in one, four times more where a round has ruled out less than a tenth of them, and MOST_PIVOTS
    at most. Other metrics take all pairs.
    """
    to = set_metric(by) if sets else metric(by)
    if by not in TRIANGLE:
        return _best(_all_pairs(members, to, skip_self)).drop("best")
    members = cut(members) if sets and by in ("jaccard", "jaccard0") else members
    known = overlap_bounds(members, 1.0 if by == "jaccard" else 0.0) if sets and by in ("jaccard", "jaccard0") else None
    return _best(measured_members(members, to, skip_self, first, known)).drop("best")


def _by_size(cells: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their cells as a matrix) of the sets of each size."""
    size = np.asarray(cells.value_lengths().fill_null(0)).astype(np.int64)
    flat, start = cells.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(size) - size
    for s in np.unique(size).tolist():
        rows = np.flatnonzero(size == s)
        yield rows, flat[start[rows, None] + np.arange(s)]


def _pairs(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each cell, one for each pair of cells) of sets of one size, as matrices."""
    a, b = np.triu_indices(cells.shape[1], 1)
    return cells << 32 | cells, cells[:, a] << 32 | cells[:, b]


def _counted(keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct keys in their order, the last one first, with their summed n."""
    order = np.lexsort(keys)
    keys = [x[order] for x in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in keys], axis=0)
    at = np.flatnonzero(new)
    return [x[at] for x in keys], np.add.reduceat(n[order], at)


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(m, k, z, pair, n): how many of a portion's members of z cells have a cell or a pair of cells."""
    names, held, most = ["m", "k", "z", "pair", "n"], [], 0

    def summed() -> pa.RecordBatch:
        m, k, z, pair, n = (np.concatenate(x) for x in zip(*held, strict=True))
        (pair, z, k, m), n = _counted([pair, z, k, m], n)
        return pa.RecordBatch.from_arrays([pa.array(m, pa.int32()), pa.array(k, pa.int32()), pa.array(z, pa.int32()), pa.array(pair), pa.array(n)], names=names)

    for batch in batches:
        m, k, n = (batch[c].to_numpy() for c in ("m", "k", "n"))
        for rows, cells in _by_size(batch["sv"]):
            step = max(1, PAIRS_AT_ONCE // max(1, cells.shape[1] * (cells.shape[1] + 1) // 2))
            for i in range(0, len(rows) if cells.shape[1] else 0, step):
                own, pair = rows[i : i + step], np.hstack(_pairs(cells[i : i + step]))
                each = pair.shape[1]
                held.append([np.repeat(m[own], each), np.repeat(k[own], each), np.full(pair.size, cells.shape[1]), pair.ravel(), np.repeat(n[own], each)])
                most += pair.size
                if most >= PAIRS_AT_ONCE:
                    yield summed()
                    held, most = [], 0
    if held:
        yield summed()


def _packed_counts(rows: pa.Table) -> pa.Table:
    """A slice of a cluster's counts as bytes, by pair."""
    z, pair, n = (rows[c].to_numpy() for c in ("z", "pair", "n"))
    order = np.argsort(pair, kind="stable")
    packed = [pa.array([x[order].astype(t).tobytes()], pa.binary()) for x, t in ((z, np.int32), (pair, np.int64), (n, np.int64))]
    return pa.table([rows["m"][:1], rows["k"][:1], rows["slice"][:1], *packed], names=["m", "k", "slice", "zs", "pairs", "ns"])


def _similarities(slices: int, empty_value: float):
    """(m, k, sv, n, size, least, most) of a cluster's members and a slice of its counts: bounds of what the slice adds to the sums of similarities."""

    def run(members: pa.Table, table: pa.Table) -> pa.Table:
        sets, count = members["sv"].combine_chunks(), members["n"].to_numpy()
        sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
        least, most = np.zeros(len(count)), np.zeros(len(count))
        if table.num_rows:
            z, pair, n = (np.frombuffer(table[c][0].as_py(), t) for c, t in (("zs", np.int32), ("pairs", np.int64), ("ns", np.int64)))
            start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            known = pair[start]
            part = table["slice"][0].as_py()
        for rows, cells in _by_size(sets):
            s = cells.shape[1]
            if s == 0:
                # No other member is empty. It counts once, whatever the slices.
                own = count[rows] * (1.0 - empty_value) / slices
                least[rows], most[rows] = own, own
            elif table.num_rows:
                top = np.minimum(s, z)
                f = lambda t: t / (s + z - t)  # noqa: B023, E731
                one, two, each = f(1), f(2) if s > 1 else 0.0, np.maximum(top * (top - 1) / 2, 1)
                kinds = [np.add.reduceat(n * c, start) for c in (one, two - 2 * one, (f(top) - top * one) / each)]
                step = max(1, PAIRS_AT_ONCE // (s * s))
                for i in range(0, len(rows), step):
                    single, double = _pairs(cells[i : i + step])
                    for found, add in ((single, (kinds[0], kinds[0])), (double, kinds[1:])):
                        here = (found >> 32) % slices == part
                        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                        least[rows[i : i + step]] += np.where(here, add[0][at], 0.0).sum(1)
                        most[rows[i : i + step]] += np.where(here, add[1][at], 0.0).sum(1)
        return pa.table([*[members[c] for c in ("m", "k", "sv", "n", "size")], pa.array(least), pa.array(most)], names=["m", "k", "sv", "n", "size", "least", "most"])

    return run


def overlap_bounds(members: DataFrame, empty_value: float) -> DataFrame:
    """(m, k, sv, n, size, low, high) of sets: bounds of the sum of Jaccard distances to all members, from counts of cells and pairs of cells.

    Sets of s and z cells with t in common have a similarity f(t) = t / (s + z - t). How many members of z cells have a cell, or two,
    of a set gives the sums of t and of t (t - 1) / 2 over these. All derivatives of f being positive, the quadratic through f at
    0, 1 and 2 is nowhere above it, and that through 0, 1 and the most that t may be, nowhere below. Both are f where t is 2 at most.

    Members stay whole: pairs are counted where a task reads them, and shards of a cluster's members meet its counts, or slices
    of them. How many counts there are depends on the cells of a subspace, not on the members. sv must be sorted, m and k ints.
    """
    members = members.select(F.col("m").cast("int").alias("m"), F.col("k").cast("int").alias("k"), F.col("sv").cast("array<int>").alias("sv"), F.col("n").cast("long").alias("n"))
    counts = members.mapInArrow(_pair_counts, "m int, k int, z int, pair long, n long").groupBy("m", "k", "z", "pair").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    slices = -(-(counts.groupBy("m", "k").count().agg(F.max("count")).first()[0] or 1) // SLICE_COUNTS)
    sizes = cut(members.groupBy("m", "k").agg(F.sum("n").alias("size"), F.ceil(F.count("*") / SHARD_MEMBERS).cast("int").alias("shards")))
    packed = counts.withColumn("slice", (F.shiftright("pair", 32) % slices).cast("int")).groupBy("m", "k", "slice").applyInArrow(_packed_counts, "m int, k int, slice int, zs binary, pairs binary, ns binary")
    tables = packed.join(sizes.select("m", "k", "shards"), ["m", "k"]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    dealt = members.join(sizes, ["m", "k"]).withColumn("shard", F.pmod(F.xxhash64("sv"), F.col("shards")).cast("int")).drop("shards")
    dealt = dealt.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    keys = ["m", "k", "shard", "slice"]
    found = dealt.groupBy(*keys).cogroup(tables.groupBy(*keys)).applyInArrow(_similarities(slices, empty_value), "m int, k int, sv array<int>, n long, size long, least double, most double")
    if slices > 1:
        found = found.groupBy("m", "k", "sv", "n", "size").agg(F.sum("least").alias("least"), F.sum("most").alias("most"))
    return found.select("m", "k", "sv", "n", "size", (F.col("size") - F.col("most")).alias("low"), (F.col("size") - F.col("least")).alias("high"))


def measured_members(members: DataFrame, to: Metric, skip_self: bool = True, first: int = FIRST_PIVOTS, known: DataFrame | None = None) -> DataFrame:
    """(m, k, sv, total) of the members that had to be measured to be sure of each cluster's best; `known` are their bounds (m, k, sv, n, size, low, high)."""
    own = (to(F.col("sv"), F.col("sv")) if skip_self else F.lit(0.0)).cast("double").alias("own")
    whole = Window.partitionBy("m", "k")
    # bound: of the sum over all members, x itself n times; own corrects it where x counts once less.
    none, totals, count, before = F.lit(None).cast("double").alias("total"), None, first, None
    if known is None:
        size = members.groupBy("m", "k").agg(F.sum("n").alias("size"))
        left = cut(members.join(size, ["m", "k"]).select("m", "k", "sv", "n", "size", F.lit(0.0).alias("bound"), none, own))
        points = left.select("m", "k", "sv", "n")
    else:
        points, left = members.select("m", "k", "sv", "n"), cut(known.select("m", "k", "sv", "n", "size", F.col("low").alias("bound"), "high", none, own))
        least = left.groupBy("m", "k").agg(F.min(F.col("high") - F.col("own")).alias("least"))
        left = cut(left.join(least, ["m", "k"]).where(F.col("bound") - F.col("own") <= F.col("least") + SLACK * (F.col("size") + 1)).select("m", "k", "sv", "n", "size", "bound", "total", "own"))
    while True:
        # A group limit: each task ranks and keeps `count` members a cluster before they are shuffled.
        order = F.row_number().over(whole.orderBy("bound", F.xxhash64("sv"), "sv"))
        pivots = cut(left.where("total is null").withColumn("at", order).where(F.col("at") <= count).select("m", "k", F.col("sv").alias("pivot"), "own"))
        packed = pivots.groupBy("m", "k").agg(F.collect_list(F.struct("pivot", "own")).alias("pivots"))
        # Sent, unless they are many: clusters differ in size, and a join on them would put a large one into one task.
        small = (pivots.agg(F.sum(F.size("pivot") * 8 + 32)).first()[0] or 0) <= BROADCAST_BYTES
        measured = points.join(F.broadcast(packed) if small else packed, ["m", "k"]).select("m", "k", "n", F.explode("pivots").alias("p"), "sv").select("m", "k", F.col("p.pivot").alias("pivot"), (to(F.col("p.pivot"), F.col("sv")) * F.col("n")).alias("d"))
        sums = measured.groupBy("m", "k", "pivot").agg(F.sum("d").alias("s"))
        sums = cut(sums.join(pivots, ["m", "k", "pivot"]).select("m", "k", F.col("pivot").alias("sv"), "s", (F.col("s") - F.col("own")).alias("total")))
        totals = sums.select("m", "k", "sv", "total") if totals is None else cut(totals.unionByName(sums.select("m", "k", "sv", "total")))
        best = _best(totals)
        bounds = sums.groupBy("m", "k").agg(F.collect_list(F.struct(F.col("sv").alias("p"), "s")).alias("pivots"))
        low = lambda p: F.abs(F.col("size") * to(F.col("sv"), p["p"]) - p["s"])
        rest = left.join(sums.select("m", "k", "sv"), ["m", "k", "sv"], "left_anti").join(bounds, ["m", "k"], "left").join(best.select("m", "k", "best"), ["m", "k"])
        rest = rest.withColumn("bound", F.greatest("bound", F.coalesce(F.array_max(F.transform("pivots", low)), F.lit(0.0))))
        left = cut(rest.where(F.col("bound") - F.col("own") <= F.col("best") + SLACK * (F.col("size") + 1)).select("m", "k", "sv", "n", "size", "bound", "total", "own"))
        most = left.groupBy("m", "k").count().agg(F.max("count")).first()[0]
        if most is None:
            return totals
        # Where the last pivots have ruled out few, bounds don't help, and larger rounds save some.
        count = 4 * count if before is not None and most > 0.9 * (before - count) else int(most**0.5)
        count, before = min(max(count, first), MOST_PIVOTS), most


def kmedoids(sub: DataFrame, ks: int, by: str | Metric = "jaccard0", form: str = "sum", max_steps: int | None = 50, seed: int = 0, scale: bool = False, start: str = "random") -> tuple[DataFrame, DataFrame]:
    """(codebook, codes) by alternating assignment and medoid choice until the codebook stays.

    `form` is "sum" (least summed distance) or "snap" (the member nearest the mean);
    `start` is "random" or "k-medoids++" (drawn by squared distance, under the metric).
    Scaling is for Euclidean metrics: it would fill the zeros that Jaccard metrics look at.
    """
    if form not in ("sum", "snap"):
        raise ValueError(f"unknown form {form!r}")
    if start not in ("random", "k-medoids++"):
        raise ValueError(f"unknown start {start!r}")
    sub = cut(autoscale(sub) if scale else sub)
    points = cut(distinct_subvectors(sub))
    book = cut(random_start(sub, ks, seed)) if start == "random" else spread_centroids(sub, ks, seed, by)
    for _ in numbered_steps(max_steps):
        if form == "sum":
            new = summed_medoids(assign(points, book, by), by)
            new = book.select("m", "k", F.col("centroid").alias("old")).join(new, ["m", "k"], "left").select("m", "k", F.coalesce("centroid", "old").alias("centroid"))
        else:
            codes = assign(sub, book, by)
            new = snapped(codes, updated_centroids(codes, book), by)
        new = cut(new)
        if new.select("m", "k", "centroid").exceptAll(book.select("m", "k", "centroid")).isEmpty():
            break
        book = new
    return book, assign(sub, book, by)


def core_points(points: DataFrame, eps: float, min_samples: int, by: str | Metric = "jaccard0") -> tuple[DataFrame, DataFrame]:
    """(pairs, cores) of distinct weighted points (m, sv, n).

    pairs (m, a, b, nb, d) are within eps, itself included; a core has min_samples points within eps.
    Jaccard pairs come from an index of prefixes of their active entries, those of other metrics from all pairs.
    """
    if by in ("jaccard", "jaccard0"):
        numbered = cut(points.withColumn("id", F.monotonically_increasing_id()))
        active = lambda v: F.filter(F.transform(v, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())
        found = cut(near_sets(numbered.select("id", "m", active(F.col("sv")).alias("cells")), eps))
        of = lambda c, more: numbered.select(F.col("id").alias(c), F.col("sv").alias(f"sv_{c}"), *more)
        both = found.unionByName(found.select("m", F.col("b").alias("a"), F.col("a").alias("b"), "d"))
        itself = 1.0 if by == "jaccard" else 0.0
        alone = numbered.select("m", F.col("sv").alias("a"), F.col("sv").alias("b"), F.col("n").alias("nb"), F.when(F.exists("sv", lambda x: x != 0), 0.0).otherwise(itself).alias("d")).where(F.col("d") <= eps)
        named = both.join(of("a", []), "a").join(of("b", [F.col("n").alias("nb")]), "b").select("m", F.col("sv_a").alias("a"), F.col("sv_b").alias("b"), "nb", "d")
        pairs = cut(named.unionByName(alone))
    else:
        a, b = points.select("m", F.col("sv").alias("a")), points.select("m", F.col("sv").alias("b"), F.col("n").alias("nb"))
        pairs = cut(a.join(b, ["m"]).withColumn("d", metric(by)(F.col("a"), F.col("b"))).where(F.col("d") <= eps).select("m", "a", "b", "nb", "d"))
    cores = pairs.groupBy("m", "a").agg(F.sum("nb").alias("near")).where(F.col("near") >= min_samples).select("m", F.col("a").alias("sv"), "near")
    return pairs, cores


def dbscan_codebook(sub: DataFrame, eps: float = 0.3, min_samples: int = 5, by: str | Metric = "jaccard0") -> tuple[DataFrame, DataFrame]:
    """(codebook, codes) of density clusters: medoids of the clusters, noise coded by its nearest medoid.

    Cores within eps form clusters, border points join the smallest cluster in reach.
    Clusters are numbered from 0 by their smallest core; a subspace without any has
    one cluster around its first subvector.
    """
    points = cut(distinct_subvectors(sub))
    pairs, cores = core_points(points, eps, min_samples, by)
    cores = cut(cores)
    core_a, core_b = cores.select("m", F.col("sv").alias("a")), cores.select("m", F.col("sv").alias("b"))
    edges = cut(pairs.join(core_a, ["m", "a"], "left_semi").join(core_b, ["m", "b"], "left_semi").select("m", "a", "b"))
    label = cores.select("m", F.col("sv").alias("b"), F.col("sv").alias("label"))
    while True:  # smallest label in reach, then that label's own label
        near = edges.join(label, ["m", "b"]).groupBy("m", "a").agg(F.min("label").alias("label"))
        jump = near.select("m", F.col("a").alias("label"), F.col("label").alias("further"))
        new = cut(near.join(jump, ["m", "label"]).select("m", F.col("a").alias("b"), F.col("further").alias("label")))
        done = new.exceptAll(label).isEmpty()
        label = new
        if done:
            break
    border = pairs.join(label, ["m", "b"]).groupBy("m", "a").agg(F.min("label").alias("label"))
    numbered = border.withColumn("k", F.dense_rank().over(Window.partitionBy("m").orderBy("label")) - 1)
    members = points.join(numbered.select("m", F.col("a").alias("sv"), "k"), ["m", "sv"])
    book = summed_medoids(members.select("m", "k", "sv", "n"), by)
    lone = points.join(book.select("m").distinct(), "m", "left_anti").groupBy("m").agg(F.min("sv").alias("centroid"))
    book = cut(book.unionByName(lone.select("m", F.lit(0).alias("k"), "centroid")))
    noise = assign(points.join(members.select("m", "sv"), ["m", "sv"], "left_anti").select("m", "sv"), book, by)
    coded = members.select("m", "sv", "k").unionByName(noise.select("m", "sv", "k"))
    return book, sub.join(coded, ["m", "sv"]).select("vec_id", "m", "sv", "k")
