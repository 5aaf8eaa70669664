"""Sparse quantization, near sets, bounded medoids and parallel starts against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors as vc
from tessera.functions.metrics import set_metric
from tessera.operators import medoids, neighbours, search, sparse
from tessera.operators import quantize as qz
from tessera.plans.model import PQModel, SparsePQModel

D, M = 48, 6


def rasters(spark, n=120, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, sorted(set(rng.integers(0, D, rng.integers(0, 20)).tolist()))) for i in range(n)] + [(n, []), (n + 1, None)]
    return spark.createDataFrame(rows, "vec_id long, cells array<int>").repartition(3)


def dense(vectors):
    return vectors.select("vec_id", vc.densify(F.coalesce("cells", F.array()), D).alias("embedding"))


def collected(df):
    return sorted(map(str, df.collect()))


def test_subsets_and_order_equal_the_dense_ones(spark):
    rows = rasters(spark)
    sub = sparse.subsets(rows, M, D)
    want = vc.sparse_subvectors(rows.na.drop(), M, D)
    assert collected(sub.where(f"vec_id <> {121}")) == collected(want) and sub.where("vec_id = 121 and size(cells) = 0").count() == M
    book = sparse.first_sets(sub, 9).select("m", "k", vc.densify(F.col("cells"), D // M).alias("centroid"))
    assert collected(book) == collected(qz.first_centroids(vc.subvectors(dense(rows), M, D), 9))
    for cells in ([3, 2], [2, 2], [-1], [D]):
        with pytest.raises(Exception, match="cell"):
            sparse.subsets(spark.createDataFrame([(1, cells)], "vec_id long, cells array<int>"), M, D).collect()


@pytest.mark.parametrize("block", [64 << 20, 600])
@pytest.mark.parametrize("by", ["jaccard", "jaccard0", "gjaccard", "l2sq", "l2"])
def test_codes_and_tables_equal_the_dense_ones(spark, monkeypatch, by, block):
    monkeypatch.setattr(sparse, "BLOCK_BYTES", block)
    monkeypatch.setattr(sparse, "CELLS_AT_ONCE", 50)
    rows = rasters(spark)
    book = sparse.first_sets(sparse.subsets(rows, M, D), 9)
    full = book.select("m", "k", vc.densify(F.col("cells"), D // M).alias("centroid"))
    assert collected(sparse.encode_sets(rows, book, M, D, by)) == collected(qz.encode(dense(rows), full, M, D, by))
    found = sparse.assign_sets(sparse.subsets(rows, M, D), book, by)
    want = qz.assign(vc.subvectors(dense(rows), M, D), full, by)
    key = lambda df: sorted((r.vec_id, r.m, r.k, round(r.d, 9)) for r in df.select("vec_id", "m", "k", "d").collect())
    assert key(found) == key(want)
    queries = rows.where("vec_id < 5").withColumnRenamed("vec_id", "qid")
    tables = search.packed_tables(search.lookup_tables(vc.subvectors(dense(rows).where("vec_id < 5").withColumnRenamed("vec_id", "qid"), M, D, key="qid"), full, by))
    got = {r.qid: r.lut for r in sparse.set_tables(queries, book, M, D, by).collect()}
    assert got.keys() == {0, 1, 2, 3, 4} and all(np.allclose(got[r.qid], r.lut) for r in tables.collect())


def test_plans_have_no_array_of_the_dimension(spark):
    rows = spark.createDataFrame([(i, [i, 20000 + i]) for i in range(40)], "vec_id long, cells array<int>")
    model = SparsePQModel(21609, parts=147, ks=4, max_steps=3).fit(rows)
    codes = model.encode(rows)
    for df in (codes, model.tables(rows.withColumnRenamed("vec_id", "qid"))):
        plan = df._jdf.queryExecution().toString()
        assert "sequence" not in plan and "embedding" not in plan
    assert {len(r.codes) for r in codes.collect()} == {147}
    own = model.search(codes, rows.where("vec_id < 3").withColumnRenamed("vec_id", "qid"), 1, "hamming").collect()
    assert len(own) == 3 and all(r.dist == 0 for r in own)


@pytest.mark.parametrize("by", ["l2sq", "jaccard0"])
def test_training_ends_where_the_dense_one_does(spark, by):
    rows = rasters(spark, 60, 3)
    model = SparsePQModel(D, parts=2, ks=4, by=by).fit(rows)
    assert model.converged
    sub = sparse.subsets(rows, 2, D)
    again = sparse.assign_sets(sparse.distinct_subsets(sub), model.codebook, by)
    if by == "l2sq":
        book = model.codebook.select("m", "k", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.coalesce(F.try_element_at(F.map_from_arrays("cells", "weights"), i.cast("int")), F.lit(0.0))).alias("centroid"))
        dense_sub = vc.subvectors(dense(rows), 2, D)
        assert sorted(tuple(np.round(r.centroid, 9)) for r in qz.updated_centroids(qz.assign(dense_sub, book), book).collect()) == sorted(tuple(np.round(r.centroid, 9)) for r in book.collect())
    else:
        chosen = medoids._best(medoids._all_pairs(again.select("m", "k", F.col("cells").alias("sv"), "n"), set_metric(by), True))
        assert collected(chosen.select("m", "k", F.col("centroid").alias("cells"))) == collected(model.codebook.select("m", "k", "cells"))


@pytest.mark.parametrize("eps", [0.0, 0.2, 1 / 3, 0.5, 0.75, 0.9])
def test_near_sets_equal_all_pairs(spark, eps):
    rng = np.random.default_rng(5)
    sets = {(i, i % 2): sorted(set((rng.integers(0, 14, rng.integers(0, 16)) ** 2 // 9).tolist())) for i in range(150)}
    df = spark.createDataFrame([(i, m, c) for (i, m), c in sets.items()], "id long, m int, cells array<int>").repartition(3)
    got = {(min(r.a, r.b), max(r.a, r.b)): r.d for r in neighbours.near_sets(df, eps).collect()}
    want = {}
    for ((a, m), x), ((b, n), y) in itertools.combinations(sets.items(), 2):
        if m == n and x and y and (d := 1 - len({*x} & {*y}) / len({*x} | {*y})) <= eps:
            want[a, b] = d
    assert got == pytest.approx(want) and neighbours.near_sets(df, eps).count() == len(want)


def test_near_sets_plan_and_limits(spark):
    df = spark.createDataFrame([(1, 0, [1, 2])], "id long, m int, cells array<int>")
    plan = neighbours.near_sets(df, 0.3)._jdf.queryExecution().optimizedPlan().toString()
    assert "cell" in plan.split("Join Inner")[1] and "Cartesian" not in plan
    with pytest.raises(ValueError, match="eps"):
        neighbours.near_sets(df, 1.0)


@pytest.mark.parametrize("by, skip_self", [("l2", True), ("jaccard", True), ("jaccard", False), ("gjaccard", True), ("weighted_jaccard", False)])
def test_bounded_medoids_equal_all_pairs(spark, by, skip_self):
    rng = np.random.default_rng(7)
    rows = {(int(m), k, tuple(rng.integers(0, 3, 4).astype(float).tolist())) for m in range(2) for k in range(3) for _ in range(40)} | {(0, 0, (0.0,) * 4), (1, 2, (0.0,) * 4)}
    df = spark.createDataFrame([(m, k, list(v), int(rng.integers(1, 9))) for m, k, v in sorted(rows)], "m int, k int, sv array<double>, n long")
    want = medoids._best(medoids._all_pairs(df, medoids.metric(by), skip_self)).drop("best")
    assert collected(medoids.summed_medoids(df, by, skip_self, first=2)) == collected(want)


def test_few_members_are_measured(spark):
    rng = np.random.default_rng(1)
    rows = [(0, 0, rng.normal(size=2).tolist(), 1) for _ in range(3000)]
    df = spark.createDataFrame(rows, "m int, k int, sv array<double>, n long")
    measured = medoids.measured_members(df, medoids.metric("l2")).collect()
    x = np.array([r[2] for r in rows])
    total = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)).sum(1)
    assert min(measured, key=lambda r: r.total).sv == x[total.argmin()].tolist()
    assert len(measured) < 500  # of 3,000: less than a sixth of all pairs


def test_parallel_start(spark):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(12, 3)) * 100
    rows = [(i, m, (middles[i % 12] + rng.normal(size=3) * 0.1).tolist()) for i in range(600) for m in range(2)]
    sub = spark.createDataFrame(rows, "vec_id long, m int, sv array<double>")
    candidates = qz.oversampled(sub, 12, seed=3)
    assert {r.m: r.w for r in candidates.groupBy("m").agg(F.sum("weight").alias("w")).collect()} == {0: 600, 1: 600}
    assert candidates.count() < 2 * 5 * 2 * 2 * 12
    book = qz.parallel_centroids(sub, 12, seed=3)
    assert all(r.d < 1 for r in qz.assign(sub, book).collect()) and collected(book) == collected(qz.parallel_centroids(sub.repartition(5), 12, seed=3))
    # Fewer distinct subvectors than centroids: each is one.
    few = spark.createDataFrame([(i, 0, [float(i % 3)]) for i in range(9)], "vec_id long, m int, sv array<double>")
    assert sorted(r.centroid[0] for r in qz.parallel_centroids(few, 8).collect()) == [0, 1, 2]
    model = PQModel(6, parts=2, ks=12, start="k-means||", max_steps=9).fit(sub.groupBy("vec_id").agg(F.flatten(F.sort_array(F.collect_list("sv"))).alias("embedding")))
    assert model.codebook.count() <= 24


@pytest.mark.parametrize("ks", [2, 40])
def test_jobs_of_a_start_do_not_grow_with_ks(spark, ks):
    sub = spark.createDataFrame([(i, 0, [float(i * i % 997), float(i % 31)]) for i in range(400)], "vec_id long, m int, sv array<double>")
    spark.sparkContext.setJobGroup(f"start{ks}", "")
    qz.parallel_centroids(sub, ks)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"start{ks}"))
    spark.sparkContext.setJobGroup("", "")
    assert 0 < jobs < 70


@pytest.mark.parametrize("by", ["jaccard", "jaccard0"])
def test_overlap_bounds_leave_few_members(spark, by):
    rng = np.random.default_rng(4)
    sets = {(m, tuple(sorted(set(rng.integers(0, 20, rng.integers(0, 9)).tolist())))) for m in range(2) for _ in range(150)} | {(0, ()), (1, tuple(range(12)))}
    df = spark.createDataFrame([(m, 0, list(c), int(rng.integers(1, 5))) for m, c in sorted(sets)], "m int, k int, sv array<int>, n long")
    empty = 1.0 if by == "jaccard" else 0.0
    totals = {(r.m, tuple(r.sv)): r.total for r in medoids._all_pairs(df, set_metric(by), False).collect()}
    bounds = medoids.overlap_bounds(df, empty)
    rows = bounds.collect()
    assert len(rows) == len(totals) and all(r.low - 1e-9 <= totals[r.m, tuple(r.sv)] <= r.high + 1e-9 for r in rows)
    assert all(abs(r.low - r.high) < 1e-9 for r in rows if len(r.sv) <= 2)
    want = medoids._best(medoids._all_pairs(df, set_metric(by), True)).drop("best")
    assert collected(medoids.summed_medoids(df, by, sets=True)) == collected(want)
    measured = medoids.measured_members(df, set_metric(by), known=bounds).count()
    assert measured < medoids.measured_members(df, set_metric(by)).count() / 2


def test_overlap_bounds_in_slices_and_shards(spark, monkeypatch):
    rng = np.random.default_rng(6)
    sets = {(k, tuple(sorted(set(rng.integers(0, 25, rng.integers(0, 10)).tolist())))) for k in range(2) for _ in range(200)} | {(0, ()), (1, tuple(range(14))), (2, (3,))}
    df = spark.createDataFrame([(0, k, list(c), int(rng.integers(1, 5))) for k, c in sorted(sets)], "m int, k int, sv array<int>, n long").repartition(3)
    key = lambda rows: {(r.k, tuple(r.sv)): (r.n, r.size, round(r.low, 9), round(r.high, 9)) for r in rows}
    whole = key(medoids.overlap_bounds(df, 0.0).collect())
    for name, value in (("SLICE_COUNTS", 300), ("SHARD_MEMBERS", 40), ("PAIRS_AT_ONCE", 500)):
        monkeypatch.setattr(medoids, name, value)
    bounds = medoids.overlap_bounds(df, 0.0)
    rows = bounds.collect()
    assert len(rows) == len(sets) and key(rows) == whole
    # Members travel whole: neither they nor their pairs are met with a table by cell.
    plan = bounds._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "flatten" not in plan
