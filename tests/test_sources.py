"""Readers, filters and starts that no registered query runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate, medoids
from tessera.operators import quantize as qz
from tessera.sources import text, vecs


def test_vecs_are_read_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vecs, "RANGE_BYTES", 100)
    rows = np.arange(300, dtype=np.float32).reshape(60, 5)
    (tmp_path / "a_2.fvecs").write_bytes(vecs.encoded(rows, "fvecs"))
    (tmp_path / "b_1.fvecs").write_bytes(vecs.encoded(rows[:7] + 1000, "fvecs"))
    (tmp_path / "c.ivecs").write_bytes(vecs.encoded(np.ones((2, 3)), "ivecs"))
    found = vecs.numbered(vecs.read_vecs(spark, str(tmp_path), "fvecs"), "number").orderBy("vec_id").collect()
    assert [r.vec_id for r in found] == list(range(67)) and [r.embedding for r in found] == (rows[:7] + 1000).tolist() + rows.tolist()
    (tmp_path / "d.bvecs").write_bytes(b"")
    with pytest.raises(OSError, match="empty vector file"):
        vecs.read_vecs(spark, str(tmp_path), "bvecs")


def test_lines_of_split_files(spark, tmp_path):
    lines = [f"{k},{k + 1} {k}" if k % 7 else "  " for k in range(500)]
    (tmp_path / "x_10.txt").write_text("\r\n".join(lines))
    (tmp_path / "x_9.txt").write_text("5 6\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    found = text.load_vectors(spark, str(tmp_path), order="number").orderBy("vec_id").collect()
    sparse = text.read_sparse(spark, str(tmp_path), 600).where("file like '%x_10.txt'").orderBy("pos").collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    want = [[float(k), k + 1.0, float(k)] for k in range(500) if k % 7]
    assert [r.embedding for r in found] == [[5.0, 6.0], *want] and [r.vec_id for r in found] == list(range(len(want) + 1))
    assert [r.cells for r in sparse] == [[k, k + 1] for k in range(500) if k % 7]


def test_folder_of_mixed_files(spark, tmp_path):
    (tmp_path / "a.fvecs").write_bytes(vecs.encoded(np.array([[1, 2]]), "fvecs"))
    (tmp_path / "b.bvecs").write_bytes(vecs.encoded(np.array([[3, 4], [5, 6]]), "bvecs"))
    (tmp_path / "c.csv").write_text("7,8\n")
    (tmp_path / "d").write_text("9 10\n")
    every = text.load_folder(spark, str(tmp_path)).orderBy("vec_id").collect()
    assert [r.embedding for r in every] == [[1, 2], [3, 4], [5, 6], [7, 8], [9, 10]]
    some = text.load_folder(spark, str(tmp_path), ("bvecs", "csv")).orderBy("vec_id").collect()
    assert [(r.vec_id, r.embedding) for r in some] == [(0, [3, 4]), (1, [5, 6]), (2, [7, 8])]


def test_filters_of_files_and_truth(spark, tmp_path):
    (tmp_path / "q_24914.txt").write_text("1\n")
    (tmp_path / "q_24915.txt").write_text("2\n3\n")
    found = text.query_files(text.read_dense(spark, str(tmp_path))).orderBy("qid").collect()
    assert [(r.query_offset, r.qid, r.embedding) for r in found] == [(24915, 24915, [2.0]), (24915, 24916, [3.0])]
    (tmp_path / "truth").mkdir()
    (tmp_path / "truth" / "a.csv").write_text("1,2,x,2,9\n\nz,1\n1,5,7\n4,8\n")
    truth = text.read_ground_truth(spark, str(tmp_path / "truth"))
    assert {r.qid: r.neighbors for r in truth.collect()} == {1: [5, 7], 4: [8]}
    vectors = spark.createDataFrame([(k, [float(k)]) for k in range(8)], "vec_id long, embedding array<double>")
    assert text.first_rows(vectors, 3).count() == 3
    matrix = text.ground_truth_matrix(vectors.withColumn("embedding", F.array(F.col("vec_id").cast("int"))))
    assert {r.qid: r.neighbors for r in matrix.collect()} == {k: [k] for k in range(8)}
    assert {r.qid: sorted(r.neighbors) for r in evaluate.valid_truth(truth, vectors).collect()} == {1: [5, 7]}
    queries = spark.createDataFrame([(1,), (2,)], "qid long")
    assert [r.qid for r in evaluate.with_truth(queries, truth).collect()] == [1]


def points(spark):
    rows = [(k, 0, [float(k % 3 * 10), float(k % 2)]) for k in range(30)] + [(40, 0, [100.0, 100.0])]
    return spark.createDataFrame(rows, "vec_id long, m int, sv array<double>")


def test_starts_and_empty_clusters(spark):
    sub = points(spark)
    spread = qz.spread_centroids(sub, 3, seed=5).collect()
    assert [r.k for r in sorted(spread)] == [0, 1, 2] and len({tuple(r.centroid) for r in spread}) == 3 and [100.0, 100.0] in [r.centroid for r in spread]
    start = medoids.random_start(sub, 4, seed=1).collect()
    assert len({tuple(r.centroid) for r in start}) == 4 and sorted(r.k for r in start) == [0, 1, 2, 3]
    book = spark.createDataFrame([(0, 0, [10.0, 0.5]), (0, 1, [-900.0, -900.0])], "m int, k int, centroid array<double>")
    found = qz.assign(sub, book)
    after = lambda rule: {r.k: r.centroid for r in qz.updated_centroids(found, book, rule).collect()}[1]
    assert after("keep") == [-900.0, -900.0] and after("zeros") == [0.0, 0.0] and after("farthest") == [100.0, 100.0]
    ties = spark.createDataFrame([(0, 0, [0.0]), (0, 1, [2.0])], "m int, k int, centroid array<double>")
    middle = spark.createDataFrame([(1, 0, [1.0])], "vec_id long, m int, sv array<double>")
    assert [qz.assign(middle, ties, ties_high=high).first().k for high in (False, True)] == [0, 1]


@pytest.mark.parametrize("form", ["sum", "snap"])
def test_kmedoids_settles_on_members(spark, form):
    book, codes = medoids.kmedoids(points(spark), 3, "l2", form, seed=2)
    members = {tuple(r.sv) for r in points(spark).collect()}
    assert {tuple(r.centroid) for r in book.collect()} <= members and codes.count() == 31


def test_kmedoids_spread_start(spark):
    # Three groups far apart and a lone point: a draw by squared distance takes one of each.
    rows = [(k, 0, [float(k % 3 * 1000), float(k % 2)]) for k in range(30)] + [(40, 0, [0.0, 9000.0])]
    sub = spark.createDataFrame(rows, "vec_id long, m int, sv array<double>")
    book, codes = medoids.kmedoids(sub, 4, "l2", seed=2, start="k-medoids++")
    assert {(round(r.centroid[0], -3), round(r.centroid[1], -3)) for r in book.collect()} == {(0, 0), (1000, 0), (2000, 0), (0, 9000)}
    assert codes.count() == 31
    with pytest.raises(ValueError, match="unknown start"):
        medoids.kmedoids(sub, 4, "l2", start="nothing")


def test_restarts_keep_the_least_error(spark):
    rng = np.random.default_rng(3)
    rows = [(k, m, rng.normal(size=2).tolist()) for k in range(16) for m in range(2)]
    sub = spark.createDataFrame(rows, "vec_id long, m int, sv array<double>")
    error = lambda t: {r.m: r.total for r in t.codes.groupBy("m").agg(F.sum("d").alias("total")).collect()}
    single = [error(qz.train(sub, qz.spread_centroids(sub, 2, 7 + 2 * r))) for r in range(2)]
    best = qz.train_restarted(sub, 2, restarts=2, seed=7)
    assert best.converged and error(best) == pytest.approx({m: min(s[m] for s in single) for m in (0, 1)})
    with pytest.raises(ValueError, match="restarts"):
        qz.train_restarted(sub, 4, restarts=0)


def test_user_centroid(spark):
    rows = [(k, p) for k, p in enumerate([[0.0], [1.0], [8.0], [50.0], [51.0], [58.0]])]
    data = spark.createDataFrame(rows, "vec_id long, point array<double>")
    centers = spark.createDataFrame([(0, [0.0]), (1, [60.0])], "k int, center array<double>")
    median = lambda sv: F.array(F.median(sv[0]))
    done = qz.kmeans(data, centers, centroid=median)
    assert done.converged and {r.k: r.centroid for r in done.codebook.collect()} == {0: [1.0], 1: [51.0]}
    sub = data.select("vec_id", F.lit(0).alias("m"), F.col("point").alias("sv"))
    book = centers.select(F.lit(0).alias("m"), "k", F.col("center").alias("centroid"))
    with pytest.raises(ValueError, match="weights"):
        qz.updated_centroids(qz.assign(sub, book).withColumn("n", F.lit(1)), book, weight="n", centroid=median)


def test_codes_in_one_row_equal_assigned_ones(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: F.abs(x)).alias("embedding"))
    sub = qz.subvectors(vectors, 8, 64)
    book = qz.first_centroids(sub, 16)
    for by in ("l2sq", "l2", "jaccard", "jaccard0", "gjaccard"):
        want = {r.vec_id: r.codes for r in qz.packed_codes(qz.assign(sub, book, by)).collect()}
        assert {r.vec_id: r.codes for r in qz.encode(vectors, book, 8, 64, by).collect()} == want
    assert {r.vec_id: r.codes for r in qz.encode(vectors, book, 8, 64, "weighted_jaccard").collect()}.keys() == want.keys()


def test_vecs_source_skips_what_filters_leave_out(spark, tmp_path):
    rows = np.arange(500, dtype=np.float32).reshape(100, 5)
    (tmp_path / "a.fvecs").write_bytes(vecs.encoded(rows[:60], "fvecs"))
    (tmp_path / "b.fvecs").write_bytes(vecs.encoded(rows[60:], "fvecs"))
    (tmp_path / "c.ivecs").write_bytes(vecs.encoded(np.ones((2, 3)), "ivecs"))
    vecs.register(spark)
    read = lambda condition="true": spark.read.format("vecs").option("kind", "fvecs").option("rangeBytes", 240).load(str(tmp_path)).where(condition)
    key = lambda df: sorted((r.vec_id, r.embedding) for r in df.collect())
    assert key(read()) == [(k, v) for k, v in enumerate(rows.tolist())] and read().rdd.getNumPartitions() == 10
    for condition, parts in (("vec_id < 15", 2), ("vec_id >= 55 and vec_id <= 64", 2), ("vec_id = 99", 1), ("vec_id in (3, 71, 72)", 2), ("vec_id > 7 and embedding[0] < 100", 10), ("vec_id < 0", 1), ("vec_id in (5, 6) and vec_id <> 5", 1)):
        df = read(condition)
        assert key(df) == [(k, v) for k, v in enumerate(rows.tolist()) if spark.range(1).selectExpr(condition.replace("vec_id", f"{k}L").replace("embedding[0]", f"{v[0]}")).first()[0]] if parts > 5 else True
        assert df.rdd.getNumPartitions() == parts
    assert [k for k, _ in key(read("vec_id in (3, 71, 72)"))] == [3, 71, 72] and [k for k, _ in key(read("vec_id < 15"))] == list(range(15))
    assert [k for k, _ in key(read("vec_id >= 55 and vec_id <= 64"))] == list(range(55, 65)) and key(read("vec_id < 0")) == []
    assert spark.read.format("vecs").option("kind", "ivecs").load(str(tmp_path)).schema.simpleString() == "struct<vec_id:bigint,embedding:array<int>>"
    with pytest.raises(Exception, match="no vectors"):
        spark.read.format("vecs").option("kind", "bvecs").load(str(tmp_path)).collect()


def test_text_writers(spark, tmp_path):
    rows = [(k, [float(np.float32(1.1) ** k), -0.0, float("nan"), 1e-30]) for k in range(50)]
    text.write_dense(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5), str(tmp_path / "d"))
    back = {r.vec_id: r.embedding for r in text.load_vectors(spark, str(tmp_path / "d"), "txt").collect()}
    assert len(back) == 50 and all(np.array_equal(np.float32(v), np.float32(back[k]), equal_nan=True) for k, v in rows)
    for bad in (None, []):
        with pytest.raises(Exception, match="without entries"):
            text.write_dense(spark.createDataFrame([(1, bad)], "vec_id long, embedding array<float>"), str(tmp_path / f"bad{bad}"))
    cells = spark.createDataFrame([(5, [3, 1]), (2, []), (3, None), (4, [0])], "vec_id long, cells array<int>")
    text.write_sparse(cells, str(tmp_path / "s"))
    assert [(r.vec_id, r.cells) for r in text.load_vectors(spark, str(tmp_path / "s"), "txt", 4, sparse=True).orderBy("vec_id").collect()] == [(0, [0]), (1, [1, 3])]
    text.write_ground_truth(spark.createDataFrame([(9, [4, 2]), (7, [])], "qid long, neighbors array<long>"), str(tmp_path / "t"))
    assert {r.qid: r.neighbors for r in text.read_ground_truth(spark, str(tmp_path / "t")).collect()} == {9: [4, 2], 7: []}
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    text.write_dense(empty, str(tmp_path / "e"))
    assert text.load_vectors(spark, str(tmp_path / "e"), "txt").count() == 0
