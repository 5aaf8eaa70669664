"""Vector operators against literal cases and NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import metrics as mt
from tessera.functions import vectors as vc
from tessera.operators import evaluate, medoids, quantize, search
from tessera.plans import queries
from tessera.plans.model import PQModel
from tessera.sources import text, vecs


def test_metrics(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 0.0], [2.0, 1.0, 0.0]), ([0.0, 0.0, 0.0], [0.0, 0.0, 0.0]), ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = rows.select(mt.l2_squared(a, b), mt.binary_jaccard(a, b), mt.binary_jaccard(a, b, 0.0), mt.weighted_jaccard(a, b), mt.general_jaccard(a, b), mt.hamming(a, b)).collect()
    assert [tuple(np.round(list(r), 6)) for r in got] == [(2, 0, 0, 0.5, 0.5, 2), (0, 1, 0, 0, 1, 0), (2, 1, 1, 1, 1, 2)]
    with pytest.raises(ValueError):
        mt.metric("nothing")


def test_user_metric(spark):
    rows = spark.createDataFrame([([1.0, 5.0], [4.0, 1.0])], "a array<double>, b array<double>")
    assert rows.select(mt.user_metric(lambda x, y: abs(x - y).max())(F.col("a"), F.col("b"))).first()[0] == 4.0


def test_zorder_and_shapes(spark):
    assert vc.zorder_cells(4) == [0, 2, 1, 3]
    assert vc.zorder_cells(147 * 147)[:8] == [0, 147, 1, 148, 294, 441, 295, 442]
    assert vc.zorder_cells(6) is None
    with pytest.raises(ValueError):
        vc.width(10, 3)
    assert spark.range(1).select(vc.parse_cells(F.lit("3,1, 2 2"))).first()[0] == [1, 2, 3]
    assert spark.range(1).select(vc.fix_dimension(F.array(F.lit(1.0)), 3)).first()[0] == [1.0, 0.0, 0.0]


def test_kmeans_smoke(spark):
    points = spark.createDataFrame([(k, p) for k, p in enumerate([[1.0, 2.0], [1.5, 1.8], [5.0, 8.0], [8.0, 8.0], [1.0, 0.6], [9.0, 11.0], None])], "vec_id long, point array<double>")
    centers = spark.createDataFrame([(0, [1.0, 2.0]), (1, [5.0, 8.0])], "k int, center array<double>")
    done = quantize.kmeans(points, centers, 100)
    assert done.converged
    assert [r.k for r in done.codes.orderBy("vec_id").collect()] == [0, 0, 1, 1, 0, 1, -1]


def test_kmeans_converges_beyond_30_steps(spark, tmp_path, monkeypatch):
    # Integers on a line, all 16 centroids at its low end: the same in each of the 8 subspaces.
    data = np.random.default_rng(0).permutation(90).astype(float)
    centers, codes, steps = np.sort(data)[:16], None, 0
    while True:
        steps += 1
        now = np.abs(data[:, None] - centers).argmin(1)
        if codes is not None and (now == codes).all():
            break
        codes, centers = now, np.array([data[now == k].mean() for k in range(16)])
    assert steps > 30
    spark.createDataFrame([(i, [x] + [0.0] * 7) for i, x in enumerate(data.tolist())], "vec_id long, e array<double>").select("vec_id", F.flatten(F.array_repeat("e", 8)).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.kmeans_converged(spark, str(tmp_path)).collect()
    assert len(got) == 8 * 90 and all(r.k == codes[r.vec_id] for r in got)
    train = quantize.train
    monkeypatch.setattr(quantize, "train", lambda sub, book: train(sub, book, max_steps=3))
    with pytest.raises(RuntimeError, match="not converged"):
        queries.kmeans_converged(spark, str(tmp_path))


@pytest.mark.parametrize("empty", ["farthest", "zeros"])
def test_steps_of_a_pass_are_those_of_single_jobs(spark, monkeypatch, empty):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(400, 2, 3)), 2)
    rows = [(i, m, x[i, m].tolist()) for i in range(400) for m in range(2)]
    sub = spark.createDataFrame(rows, "vec_id long, m int, sv array<double>").repartition(3)
    lost = spark.createDataFrame([(0, 99, [1e6] * 3)], "m int, k int, centroid array<double>")
    start = quantize.first_centroids(sub, 12).unionByName(lost)
    key = lambda done: (done.steps, done.converged, sorted((r.vec_id, r.m, r.k) for r in done.codes.collect()), sorted((r.m, r.k, tuple(np.round(r.centroid, 9))) for r in done.codebook.collect()))
    got = {}
    for name, border in (("passes", quantize.BORDER_BYTES), ("few", 1 << 13), ("single", 0)):
        monkeypatch.setattr(quantize, "BORDER_BYTES", border)
        spark.sparkContext.setJobGroup(f"{name}{empty}", "")
        got[name] = key(quantize.train(sub, start, empty=empty, max_steps=12))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{name}{empty}"))
        spark.sparkContext.setJobGroup("", "")
        # Each step was a dozen jobs.
        assert got[name][0] > 8
        assert name != "passes" or empty == "farthest" or jobs < 2 * got[name][0] + 20
    monkeypatch.setattr(quantize, "PASS_BYTES", 0)
    assert got["passes"] == got["few"] == got["single"] == key(quantize.train(sub, start, empty=empty, max_steps=12))


def test_search_matches_numpy(spark):
    rng = np.random.default_rng(4)
    data, k = rng.normal(size=(60, 8)), 5
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "vec_id long, embedding array<double>")
    queries = rows.where("vec_id < 4").select(F.col("vec_id").alias("qid"), "embedding")
    want = {q: np.lexsort((np.arange(60), np.round(((data - data[q]) ** 2).sum(1), 9)))[:k].tolist() for q in range(4)}
    exact = search.exact_topk(rows, queries, k)
    found = {q: [r.vec_id for r in exact.where(f"qid = {q}").orderBy("rank").collect()] for q in range(4)}
    assert found == want
    # One entry per subspace and a centroid for every value: codes lose nothing.
    model = PQModel(8, parts=8, ks=60, max_steps=2).fit(rows)
    got = model.search(model.encode(rows), queries, k)
    assert {q: [r.vec_id for r in got.where(f"qid = {q}").orderBy("rank").collect()] for q in range(4)} == want
    assert evaluate.recall_stats(evaluate.set_recall(got, evaluate.truth_of(exact), k)).first().mean_recall == 1.0
    own = model.search(model.encode(rows), queries, 1, "hamming")
    assert all(r.qid == r.vec_id and r.dist == 0 for r in own.collect())


def test_model_saves_and_loads(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 3), float(i % 5), 1.0, 0.0]) for i in range(20)], "vec_id long, embedding array<double>")
    model = PQModel(4, parts=2, ks=4, max_steps=3).fit(rows)
    model.save(str(tmp_path / "m"))
    again = PQModel.load(spark, str(tmp_path / "m"))
    key = lambda df: sorted((r.vec_id, r.codes) for r in df.collect())
    assert key(again.encode(rows)) == key(model.encode(rows))
    assert key(rows.select("vec_id", again.code_column(F.col("embedding")).alias("codes"))) == key(model.encode(rows))


def test_dbscan_noise_and_lone_subspace(spark):
    rows = [[1.0, 1.0, 1.0, 0.0]] * 6 + [[0.0, 0.0, 0.0, 1.0]]
    sub = spark.createDataFrame([(k, 0, v) for k, v in enumerate(rows)] + [(k, 1, v) for k, v in enumerate([[1.0, 0.0], [0.0, 1.0]])], "vec_id long, m int, sv array<double>")
    book, codes = medoids.dbscan_codebook(sub)
    assert {(r.m, r.k, tuple(r.centroid)) for r in book.collect()} == {(0, 0, (1.0, 1.0, 1.0, 0.0)), (1, 0, (0.0, 1.0))}
    assert {r.k for r in codes.collect()} == {0} and codes.count() == 9


@pytest.mark.parametrize("kind", ["fvecs", "ivecs", "bvecs"])
def test_vecs_round_trip(spark, tmp_path, kind):
    cast = {"fvecs": "float", "ivecs": "int", "bvecs": "smallint"}[kind]
    rows = spark.createDataFrame([(i, [i, i + 1, i + 2]) for i in range(9)], "vec_id long, embedding array<int>").withColumn("embedding", F.col("embedding").cast(f"array<{cast}>"))
    vecs.write_vecs(rows, str(tmp_path / "v"), kind)
    back = vecs.numbered(vecs.read_vecs(spark, f"{tmp_path}/v/*.{kind}", kind))
    assert [(r.vec_id, [int(x) for x in r.embedding]) for r in back.orderBy("vec_id").collect()] == [(i, [i, i + 1, i + 2]) for i in range(9)]
    with pytest.raises(OSError):
        vecs.decoded(b"", kind)


def test_text_sources(spark, tmp_path):
    (tmp_path / "a_2.txt").write_text("1,2\n\n3, 4\n")
    (tmp_path / "b_10.txt").write_text("0 5\n")
    got = vecs.numbered(text.read_sparse(spark, str(tmp_path), 6), "number").orderBy("vec_id").collect()
    assert [r.cells for r in got] == [[1, 2], [3, 4], [0, 5]]
    with pytest.raises(Exception, match="cell outside"):
        text.read_sparse(spark, str(tmp_path), 5).collect()
    with pytest.raises(ValueError):
        text.read_sparse(spark, str(tmp_path), None)


def test_ground_truth(spark, tmp_path):
    (tmp_path / "g.csv").write_text("1,2,3,x,3\nq,1\n2,9\n1,7\n")
    got = {r.qid: r.neighbors for r in text.read_ground_truth(spark, str(tmp_path)).collect()}
    assert got == {1: [7], 2: [9]}


def test_converged_queries_take_as_many_steps_as_they_need(spark, tmp_path):
    # Sixteen centroids spread from the left end of 12,000 places: more steps than qz.MAX_STEPS.
    spark.range(12000).select(F.col("id").alias("vec_id"), F.array_repeat(F.col("id").cast("float"), 64).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    x, c, was, at, steps = np.arange(12000.0), np.arange(16.0), None, np.zeros(12000, int), 0
    while was is None or (at != was).any():
        was, at = at, np.searchsorted((c[1:] + c[:-1]) / 2, x)
        c, steps = np.bincount(at, x) / np.bincount(at), steps + 1
    assert steps > quantize.MAX_STEPS
    got = queries.kmeans_converged(spark, str(tmp_path)).toPandas()
    assert len(got) == 8 * 12000
    for m in range(8):
        assert (got[got.m == m].sort_values("vec_id").k.to_numpy() == at).all()
    sub = queries.subs(spark, str(tmp_path))
    assert not quantize.train(sub, quantize.first_centroids(sub, 16), max_steps=40).converged
