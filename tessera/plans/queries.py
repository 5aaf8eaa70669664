"""The registered vector queries and, where SQL can say the same, their SQL.

All run over whole tables.  Searches take as queries the rows whose id is
divisible by 50, against all rows.  Arrays come out as comma-separated text or
one row per entry, floating results rounded to six digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as mt
from ..functions import vectors as vc
from ..operators import descriptors, evaluate, keypoints, medoids, profile, search, sparse
from ..operators import quantize as qz
from ..operators.lineage import cut, shared_path
from ..sources import vecs
from .model import PQModel, SparsePQModel

DIM, PARTS, KS, TOP, STEP = 64, 8, 16, 10, 50
#: Octaves of the query of keypoints, and their distance from the sides.
KEYPOINT_OCTAVES, KEYPOINT_BORDER = 2, 1


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")


def subs(spark: SparkSession, sf: str) -> DataFrame:
    return vc.subvectors(embeddings(spark, sf), PARTS, DIM)


def signs(spark: SparkSession, sf: str) -> DataFrame:
    """Binarised vectors: 1 where the entry is positive."""
    return embeddings(spark, sf).withColumn("embedding", F.transform("embedding", lambda x: (x > 0).cast("double")))


def sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of absolute values, for metrics that need them."""
    return embeddings(spark, sf).withColumn("embedding", F.transform("embedding", lambda x: F.abs(x.cast("double"))))


def rounded(c: str | Column) -> Column:
    return F.round(c, 6)


def text(c: str | Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def as_queries(vectors: DataFrame, by: str = "vec_id") -> DataFrame:
    return vectors.where(F.col(by) % STEP == 0).select(F.col(by).alias("qid"), "embedding")


def entries(book: DataFrame) -> DataFrame:
    return book.select("m", "k", F.posexplode("centroid").alias("j", "x")).select("m", "k", "j", rounded("x").alias("x"))


def pq_subvectors(spark, sf):
    return subs(spark, sf).select("vec_id", "m", F.posexplode("sv").alias("j", "x")).select("vec_id", "m", "j", rounded("x").alias("x"))


def pq_init_codebook(spark, sf):
    return entries(qz.first_centroids(subs(spark, sf), KS))


def coded(vectors: DataFrame, by: str = "l2sq", dimension: int = DIM, parts: int = PARTS) -> tuple[DataFrame, DataFrame]:
    """(codebook, assigned) with the first distinct subvectors as codebook."""
    sub = vc.subvectors(vectors, parts, dimension)
    book = cut(qz.first_centroids(sub, KS))
    return book, qz.assign(sub, book, by)


def packed(vectors: DataFrame, by: str = "l2sq", dimension: int = DIM, parts: int = PARTS) -> tuple[DataFrame, DataFrame]:
    """(codebook, codes): the same with the codes of a vector in one row."""
    book = cut(qz.first_centroids(vc.subvectors(vectors, parts, dimension), KS))
    return book, qz.encode(vectors, book, parts, dimension, by)


def pq_assign(spark, sf):
    return coded(embeddings(spark, sf))[1].select("vec_id", "m", "k", rounded("d").alias("d"))


def pq_codes_packed(spark, sf):
    return packed(embeddings(spark, sf))[1].select("vec_id", text("codes").alias("codes"))


def pq_centroid_update(spark, sf):
    book, found = coded(embeddings(spark, sf))
    return entries(qz.updated_centroids(found, book))


def pq_lloyd_2iter(spark, sf):
    sub = subs(spark, sf)
    return entries(qz.lloyd(sub, qz.first_centroids(sub, KS), 2))


def pq_quantization_error(spark, sf):
    return qz.quantization_error(coded(embeddings(spark, sf))[1]).select("m", rounded("error").alias("error"))


def shown(found: DataFrame) -> DataFrame:
    return found.select("qid", "rank", "vec_id", rounded("dist").alias("dist"))


def adc(vectors: DataFrame, by: str, train_by: str = "l2sq", k: int = TOP, dimension: int = DIM, parts: int = PARTS) -> DataFrame:
    """Search by lookup tables over codes from the first distinct subvectors."""
    book, codes = packed(vectors, train_by, dimension, parts)
    queries = vc.subvectors(as_queries(vectors), parts, dimension, key="qid")
    tables = search.packed_tables(search.lookup_tables(queries, book, by))
    return search.adc_topk(codes, tables, k)


def adc_topk_l2(spark, sf):
    return shown(adc(embeddings(spark, sf), "l2sq"))


def adc_topk_l2_unsquared(spark, sf):
    return shown(adc(embeddings(spark, sf), "l2"))


def adc_topk_jaccard(spark, sf):
    return shown(adc(signs(spark, sf), "jaccard", "jaccard"))


def adc_topk_gjaccard(spark, sf):
    return shown(adc(sizes(spark, sf), "gjaccard", "gjaccard"))


def adc_long_l2(spark, sf):
    vectors = embeddings(spark, sf)
    book, found = coded(vectors)
    tables = search.lookup_tables(vc.subvectors(as_queries(vectors), PARTS, DIM, key="qid"), book)
    return shown(search.adc_long(found.select("vec_id", "m", "k"), tables, TOP))


def hamming_topk(spark, sf):
    codes = packed(embeddings(spark, sf))[1]
    queries = codes.where(F.col("vec_id") % STEP == 0).select(F.col("vec_id").alias("qid"), "codes")
    return shown(search.hamming_topk(codes, queries, TOP))


def exact_topk_l2(spark, sf):
    vectors = embeddings(spark, sf)
    return shown(search.exact_topk(vectors, as_queries(vectors), TOP))


def exact_topk_jaccard(spark, sf):
    vectors = signs(spark, sf)
    return shown(search.exact_topk(vectors, as_queries(vectors), TOP, "jaccard"))


def exact_topk_gjaccard(spark, sf):
    vectors = sizes(spark, sf)
    return shown(search.exact_topk(vectors, as_queries(vectors), TOP, "gjaccard"))


def exact_topk_l2_unsquared(spark, sf):
    vectors = embeddings(spark, sf)
    return shown(search.exact_topk(vectors, as_queries(vectors), TOP, "l2"))


def exact_topk_hamming(spark, sf):
    vectors = signs(spark, sf)
    return shown(search.exact_topk(vectors, as_queries(vectors), TOP, "hamming"))


def zorder_adc_topk(spark, sf):
    vectors = embeddings(spark, sf).withColumn("embedding", vc.zorder_dense(F.col("embedding"), DIM))
    return shown(adc(vectors, "l2sq"))


def recalls(spark, sf, kind):
    vectors = embeddings(spark, sf)
    truth = evaluate.truth_of(search.exact_topk(vectors, as_queries(vectors), TOP))
    return kind(adc(vectors, "l2sq", k=TOP), truth, TOP)


def recall_set(spark, sf):
    return recalls(spark, sf, evaluate.set_recall).select("qid", rounded("recall").alias("recall"))


def recall_anyhit(spark, sf):
    return recalls(spark, sf, evaluate.any_recall)


def recall_first(spark, sf):
    return recalls(spark, sf, evaluate.first_recall).select("qid", rounded("recall").alias("recall"))


def recall_stats(spark, sf):
    out = evaluate.recall_stats(recalls(spark, sf, evaluate.set_recall))
    return out.select("n_queries", rounded("mean_recall").alias("mean_recall"), rounded("sd_recall").alias("sd_recall"))


def recall_histogram(spark, sf):
    out = evaluate.histogram(recalls(spark, sf, evaluate.set_recall))
    return out.select("bin", rounded("lo").alias("lo"), rounded("hi").alias("hi"), "n")


def distances(spark, sf):
    """Every metric between each vector and the next by id, on absolute values."""
    a = sizes(spark, sf).withColumn("embedding", F.transform("embedding", lambda x: F.when(x > 0.1, x).otherwise(0.0)))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    x, y = F.col("embedding"), F.col("other")
    cells = lambda v: vc.active_cells(v)
    return a.join(b, "vec_id").select(
        "vec_id", rounded(mt.l2_squared(x, y)).alias("l2sq"), rounded(mt.l2(x, y)).alias("l2"), rounded(mt.binary_jaccard(x, y)).alias("jaccard"),
        rounded(mt.set_jaccard(cells(x), cells(y))).alias("set_jaccard"), rounded(mt.weighted_jaccard(x, y)).alias("weighted"),
        rounded(mt.general_jaccard(x, y)).alias("general"), mt.hamming(x, y).alias("hamming"),
    )


def subvector_unique_profile(spark, sf):
    return profile.unique_profile(signs(spark, sf), DIM)


def subvector_zero_profile(spark, sf):
    vectors = embeddings(spark, sf).withColumn("embedding", F.transform("embedding", lambda x: F.when(x > 0.2, x.cast("double")).otherwise(0.0)))
    return profile.zero_profile(vc.subvectors(vectors, 16, DIM))


def cells_of(spark, sf):
    return embeddings(spark, sf).select("vec_id", vc.active_cells(F.col("embedding")).alias("cells"))


def sparse_cells(spark, sf):
    return cells_of(spark, sf).select("vec_id", text("cells").alias("cells"))


def sparse_parts(spark, sf):
    return vc.sparse_subvectors(cells_of(spark, sf), PARTS, DIM).select("vec_id", "m", text("cells").alias("cells"))


def dense_again(spark, sf):
    """Sparse vectors densified: how many entries, and how many ones."""
    dense = vc.densify(F.col("cells"), DIM)
    return cells_of(spark, sf).select("vec_id", F.size(dense).alias("n"), F.aggregate(dense, F.lit(0.0), lambda a, x: a + x).alias("ones"))


def zorder_permutation(spark, sf):
    """The Z-order rank of each cell that is active in the parcels, and in how many it is."""
    active = parcels(spark, sf).select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    return active.join(vc.zorder(spark, PARCEL), "cell").select("rank", "cell", "n")


def zorder_sparse(spark, sf):
    return vc.zorder_sparse(spark, cells_of(spark, sf), DIM).select("vec_id", text("cells").alias("cells"))


def autoscale(spark, sf):
    out = medoids.autoscale(subs(spark, sf)).select("vec_id", "m", F.posexplode("sv").alias("j", "x"))
    return out.select("vec_id", "m", "j", rounded("x").alias("x"))


def kmedoid_snap(spark, sf):
    book, found = coded(embeddings(spark, sf))
    return entries(medoids.snapped(found, qz.updated_centroids(found, book)))


def weighted_members(spark, sf):
    """Distinct binarised subvectors, clustered by the first of each subspace."""
    sub = vc.subvectors(signs(spark, sf), 16, DIM)
    points = qz.distinct_subvectors(sub)
    return qz.assign(points, qz.first_centroids(sub, 4), "jaccard0")


def exact_medoid(spark, sf):
    return entries(medoids.summed_medoids(weighted_members(spark, sf).select("m", "k", "sv", "n"), "jaccard0"))


def dbscan_core_points(spark, sf):
    points = qz.distinct_subvectors(vc.subvectors(signs(spark, sf), PARTS, DIM))
    _, cores = medoids.core_points(points, 0.3, 5)
    return cores.select("m", text(F.transform("sv", lambda x: x.cast("int"))).alias("sv"), "near")


def dbscan_codebook(spark, sf):
    return entries(medoids.dbscan_codebook(vc.subvectors(signs(spark, sf), PARTS, DIM))[0])


def kmeans_converged(spark, sf):
    sub = subs(spark, sf)
    done = qz.train(sub, qz.first_centroids(sub, KS))
    if not done.converged:
        raise RuntimeError(f"k-means has not converged in {done.steps} steps")
    return done.codes.select("vec_id", "m", "k")


def kmedoids_jaccard(spark, sf):
    return medoids.kmedoids(vc.subvectors(signs(spark, sf), 16, DIM), 4)[1].select("vec_id", "m", "k")


def fix_dimension(spark, sf):
    longer, shorter = (vc.fix_dimension(vc.as_double(F.col("embedding")), n) for n in (80, 48))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return embeddings(spark, sf).select("vec_id", F.size(longer).alias("n_long"), F.size(shorter).alias("n_short"), rounded(total(longer)).alias("sum_long"), rounded(total(shorter)).alias("sum_short"))


def customer_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Per customer the quantities bought by part number modulo 16."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity")
    bought = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("vec_id"), (F.col("l_partkey") % 16).cast("int").alias("j")).agg(F.sum("l_quantity").cast("double").alias("q"))
    per = bought.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("j", "q"))).alias("q"))
    return per.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: F.coalesce(F.try_element_at("q", j), F.lit(0.0))).alias("embedding"))


def customer_adc_gjaccard(spark, sf):
    return shown(adc(cut(customer_vectors(spark, sf)), "gjaccard", "gjaccard", dimension=16, parts=4))


def model_search(spark, sf):
    """Fit, encode and search through the model's interface."""
    vectors = embeddings(spark, sf)
    model = PQModel(DIM, parts=4, ks=KS, max_steps=None).fit(vectors)
    if not model.converged:
        raise RuntimeError("the model's training has not converged")
    return shown(model.search(model.encode(vectors), as_queries(vectors), TOP))


def descriptors_8x8(spark, sf):
    out = descriptors.describe(cells_of(spark, sf), 8)
    return out.select("vec_id", *[rounded(F.aggregate(F.transform(c, lambda x: F.abs(x.cast("double"))), F.lit(0.0), lambda a, x: a + x)).alias(c) for c in descriptors.FIELDS])


def descriptor_edges(spark, sf):
    """Edge histograms of the binarised vectors as 8 x 8 rasters, one row per entry that is not zero."""
    out = descriptors.edge_histograms(cells_of(spark, sf), 8)
    return out.select("vec_id", F.posexplode("v").alias("entry", "x")).where("x <> 0").select("vec_id", "entry", rounded("x").alias("x"))


def descriptor_keypoints(spark, sf):
    """Mean descriptors of the keypoints of the binarised vectors as 8 x 8 rasters, two octaves, one row per entry that is not zero."""
    out = keypoints.pooled_entries(cells_of(spark, sf), 8, KEYPOINT_OCTAVES, KEYPOINT_BORDER)
    return out.select("vec_id", F.col("at").alias("entry"), F.round("x", 3).alias("x")).where("x <> 0")


def parcels(spark: SparkSession, sf: str) -> DataFrame:
    """Rasters of 42 x 42 cells: per customer the cells that its order keys and line numbers name."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey")
    cell = (F.col("l_partkey") % 1764).cast("int")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("vec_id")).agg(F.collect_set(cell).alias("cells"))


def descriptor_gradients(spark, sf):
    """HOG of the rasters that customers' parts draw, one row per entry that is not zero."""
    out = descriptors.gradient_histograms(parcels(spark, sf), 42)
    return out.select("vec_id", F.posexplode("v").alias("entry", "x")).where("x <> 0").select("vec_id", "entry", rounded("x").alias("x"))


def trained_recall(spark, sf):
    """Recall of the true nearest neighbours by codes of a codebook that is trained until it converges."""
    vectors = embeddings(spark, sf)
    model = PQModel(DIM, parts=PARTS, ks=KS, max_steps=None).fit(vectors)
    if not model.converged:
        raise RuntimeError("the model's training has not converged")
    queries = as_queries(vectors)
    truth = evaluate.truth_of(search.exact_topk(vectors, queries, TOP))
    found = model.search(model.encode(vectors), queries, 100)
    stats = evaluate.recall_stats(evaluate.set_recall(found, truth, 100))
    return stats.select("n_queries", rounded("mean_recall").alias("mean_recall"), rounded("sd_recall").alias("sd_recall"))


def kmedoids_one_step(spark, sf):
    """Codes by the medoids of the clusters around the first distinct subvectors."""
    points = weighted_members(spark, sf)
    book = medoids.summed_medoids(points.select("m", "k", "sv", "n"), "jaccard0")
    return qz.assign(vc.subvectors(signs(spark, sf), 16, DIM), book, "jaccard0").select("vec_id", "m", "k", rounded("d").alias("d"))


def model_search_2iter(spark, sf):
    """Search by a codebook after two Lloyd steps, through lookup tables over packed codes."""
    vectors = embeddings(spark, sf)
    sub = vc.subvectors(vectors, 4, DIM)
    model = PQModel(DIM, parts=4, ks=KS, codebook=qz.lloyd(sub, qz.first_centroids(sub, KS), 2))
    return shown(model.search(model.encode(vectors), as_queries(vectors), TOP))


PARCEL, PARCEL_PARTS = 42 * 42, 12


def parcel_queries(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The parcels with sorted cells, and those with an id divisible by 50 as queries."""
    vectors = cut(parcels(spark, sf).select("vec_id", F.array_sort("cells").alias("cells")))
    return vectors, vectors.where(F.col("vec_id") % STEP == 0).select(F.col("vec_id").alias("qid"), "cells")


def sparse_adc_topk(spark, sf):
    """Search by lookup tables over codes of sparse rasters, from the first distinct subsets of each subspace."""
    vectors, queries = parcel_queries(spark, sf)
    book = cut(sparse.first_sets(sparse.subsets(vectors, PARCEL_PARTS, PARCEL), KS))
    codes = sparse.encode_sets(vectors, book, PARCEL_PARTS, PARCEL, "jaccard")
    return shown(search.adc_topk(codes, sparse.set_tables(queries, book, PARCEL_PARTS, PARCEL, "jaccard"), TOP))


def sparse_kmedoids_step(spark, sf):
    """The medoids of the clusters around the first distinct subsets of sparse rasters, one row per cell."""
    sub = sparse.subsets(parcel_queries(spark, sf)[0], PARCEL_PARTS, PARCEL)
    found = cut(sparse.assign_sets(sparse.distinct_subsets(sub), cut(sparse.first_sets(sub, KS)), "jaccard0"))
    book = medoids.summed_medoids(found.select("m", "k", F.col("cells").alias("sv"), "n"), "jaccard0", sets=True)
    return book.select("m", "k", F.explode_outer("centroid").alias("cell"))


def sparse_means_step(spark, sf):
    """The means of the clusters around the first distinct subsets of sparse rasters, one row per cell."""
    sub = sparse.subsets(parcel_queries(spark, sf)[0], PARCEL_PARTS, PARCEL)
    book = cut(sparse.first_sets(sub, KS))
    means = sparse.updated_means(cut(sparse.assign_sets(sparse.distinct_subsets(sub), book, "l2sq")), book)
    return means.select("m", "k", F.explode(F.arrays_zip("cells", "weights")).alias("e")).select("m", "k", F.col("e.cells").alias("cell"), rounded("e.weights").alias("weight"))


def sparse_model_search(spark, sf):
    """Sparse rasters through the model's interface, trained until its medoids stay."""
    vectors, queries = parcel_queries(spark, sf)
    model = SparsePQModel(PARCEL, parts=4, ks=8).fit(vectors)
    if not model.converged:
        raise RuntimeError("the model's training has not converged")
    return shown(model.search(model.encode(vectors), queries, TOP))


def kmedoids_2iter(spark, sf):
    """Codes after two steps of medoids from the first distinct subvectors."""
    sub = vc.subvectors(signs(spark, sf), 16, DIM)
    points, book = cut(qz.distinct_subvectors(sub)), qz.first_centroids(sub, 4)
    for _ in range(2):
        book = cut(medoids.summed_medoids(qz.assign(points, book, "jaccard0").select("m", "k", "sv", "n"), "jaccard0"))
    return qz.assign(sub, book, "jaccard0").select("vec_id", "m", "k", rounded("d").alias("d"))


def subvector_unique_sketch(spark, sf):
    """Distinct subvectors by sketches, with a standard error of 1.6 %."""
    return profile.unique_profile(signs(spark, sf), DIM, sketch=True)


def vecs_round_trip(spark, sf):
    """The embeddings written as fvecs files and read back by the data source, numbered in the order of vec_id."""
    vecs.register(spark)
    path = shared_path(spark)
    vecs.write_vecs(embeddings(spark, sf), path)
    back = spark.read.format("vecs").option("kind", "fvecs").load(path)
    return back.select("vec_id", F.posexplode("embedding").alias("j", "x")).select("vec_id", "j", rounded(F.col("x").cast("double")).alias("x"))


def kmeans_parallel_candidates(spark, sf):
    """The weighted candidates that a k-means|| start draws."""
    return qz.oversampled(subs(spark, sf), KS).select("m", F.col("c").alias("vec_id"), "weight")


def kmeans_parallel_error(spark, sf):
    """Mean distance to the centroids of a k-means|| start."""
    sub = subs(spark, sf)
    return qz.quantization_error(qz.assign(sub, qz.parallel_centroids(sub, KS))).select("m", rounded("error").alias("error"))


QUERIES = {
    f.__name__: f
    for f in (
        pq_subvectors, pq_init_codebook, pq_assign, pq_codes_packed, pq_centroid_update, pq_lloyd_2iter, pq_quantization_error,
        adc_topk_l2, adc_topk_l2_unsquared, adc_topk_jaccard, adc_topk_gjaccard, adc_long_l2, hamming_topk, exact_topk_l2, exact_topk_jaccard,
        exact_topk_gjaccard, exact_topk_l2_unsquared, exact_topk_hamming,
        zorder_adc_topk, recall_set, recall_anyhit, recall_first, recall_stats, recall_histogram, distances, subvector_unique_profile,
        subvector_zero_profile, sparse_cells, sparse_parts, dense_again, zorder_permutation, zorder_sparse, autoscale, kmedoid_snap, exact_medoid,
        dbscan_core_points, dbscan_codebook, kmeans_converged, kmedoids_jaccard, fix_dimension, customer_adc_gjaccard, model_search, descriptors_8x8,
        descriptor_edges, descriptor_gradients, descriptor_keypoints, trained_recall, kmedoids_one_step, model_search_2iter,
        kmedoids_2iter, subvector_unique_sketch, vecs_round_trip, sparse_adc_topk, sparse_kmedoids_step, sparse_means_step, sparse_model_search, kmeans_parallel_candidates, kmeans_parallel_error,
    )
}

# ---------------------------------------------------------------- SQL

L2SQ = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
LOW = "list_sum(list_transform(list_zip({a}, {b}), lambda z: least(z[1], z[2])))"
HIGH = "list_sum(list_transform(list_zip({a}, {b}), lambda z: greatest(z[1], z[2])))"
BOTH = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CASE WHEN z[1] <> 0 AND z[2] <> 0 THEN 1.0 ELSE 0.0 END))::DOUBLE"
EITHER = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CASE WHEN z[1] <> 0 OR z[2] <> 0 THEN 1.0 ELSE 0.0 END))::DOUBLE"
SQL_METRICS = {
    "l2sq": L2SQ,
    "l2": f"sqrt({L2SQ})",
    "jaccard": f"CASE WHEN {EITHER} = 0 THEN 1.0 ELSE 1 - {BOTH} / {EITHER} END",
    "jaccard0": f"CASE WHEN {EITHER} = 0 THEN 0.0 ELSE 1 - {BOTH} / {EITHER} END",
    "gjaccard": f"1 - {LOW} / ({HIGH} + 1e-10)",
    "hamming": "CAST(len(list_filter(list_zip({a}, {b}), lambda z: z[1] <> z[2])) AS DOUBLE)",
    "weighted": f"CASE WHEN {HIGH} = 0 THEN 0.0 ELSE 1 - {LOW} / {HIGH} END",
}


def dist_sql(by: str, a: str, b: str) -> str:
    return SQL_METRICS[by].replace("{a}", a).replace("{b}", b)


DOUBLE = "e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
SIGNS = "e AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END::DOUBLE) AS v FROM embeddings)"
SIZES = "e AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS v FROM embeddings)"
_SPREAD = " + ".join(f"((({{r}} >> {b}) & 1) << {2 * b}) + ((({{c}} >> {b}) & 1) << {2 * b + 1})" for b in range(8))
Z_ORDER = "z AS (SELECT cell, row_number() OVER (ORDER BY " + _SPREAD.replace("{r}", "(cell // {s})").replace("{c}", "(cell % {s})") + ") - 1 AS rank FROM range({n}) t(cell))"
ZORDERED = Z_ORDER.replace("{s}", "8").replace("{n}", "64") + ", e AS (SELECT vec_id, list(CAST(embedding[cell + 1] AS DOUBLE) ORDER BY rank) AS v FROM embeddings, z GROUP BY vec_id)"


def sub_sql(source: str, parts: int = PARTS, dimension: int = DIM) -> str:
    w = dimension // parts
    return f"{source}, sub AS (SELECT vec_id, CAST(m AS INTEGER) AS m, v[m * {w} + 1 : m * {w} + {w}] AS sv FROM e, range({parts}) t(m))"


def book_sql(ks: int = KS, name: str = "book") -> str:
    return f"{name} AS (SELECT m, CAST(k AS INTEGER) AS k, sv AS c FROM (SELECT m, sv, row_number() OVER (PARTITION BY m ORDER BY sv) - 1 AS k FROM (SELECT DISTINCT m, sv FROM sub)) WHERE k < {ks})"


def assign_sql(by: str = "l2sq", book: str = "book", name: str = "found", points: str = "sub") -> str:
    key = "vec_id, m, sv" if points == "sub" else "m, sv, n"
    cols = ", ".join(f"s.{x}" for x in key.split(", "))
    return f"{name} AS (SELECT {key}, k, d FROM (SELECT {cols}, b.k, {dist_sql(by, 's.sv', 'b.c')} AS d, row_number() OVER (PARTITION BY {cols} ORDER BY {dist_sql(by, 's.sv', 'b.c')}, b.k) AS r FROM {points} s JOIN {book} b USING (m)) WHERE r = 1)"


def update_sql(found: str = "found", book: str = "book", name: str = "means") -> str:
    entry = f"(SELECT m, k, j, avg(x) AS x FROM (SELECT m, k, unnest(sv) AS x, generate_subscripts(sv, 1) AS j FROM {found}) GROUP BY m, k, j)"
    return f"{name} AS (SELECT b.m, b.k, coalesce(a.c, b.c) AS c FROM {book} b LEFT JOIN (SELECT m, k, list(x ORDER BY j) AS c FROM {entry} GROUP BY m, k) a ON a.m = b.m AND a.k = b.k)"


def entries_sql(book: str) -> str:
    return f"SELECT m, k, CAST(j - 1 AS INTEGER) AS j, round(x, 6) AS x FROM (SELECT m, k, unnest(c) AS x, generate_subscripts(c, 1) AS j FROM {book})"


def codes_sql(found: str = "found") -> str:
    return f"codes AS (SELECT vec_id, list(k ORDER BY m) AS codes FROM {found} GROUP BY vec_id)"


def top_sql(dist: str, k: int = TOP) -> str:
    return f"top AS (SELECT qid, CAST(rank AS INTEGER) AS rank, vec_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM ({dist})) WHERE rank <= {k})"


TOP_OUT = "SELECT qid, rank, vec_id, round(dist, 6) AS dist FROM top"


def adc_sql(source: str, by: str, train_by: str = "l2sq", dimension: int = DIM, parts: int = PARTS) -> str:
    tables = f"lut AS (SELECT s.vec_id AS qid, s.m, b.k, {dist_sql(by, 's.sv', 'b.c')} AS d FROM sub s JOIN book b USING (m) WHERE s.vec_id % {STEP} = 0)"
    dist = "SELECT qid, vec_id, round(list_sum(list(l.d ORDER BY m)), 9) AS dist FROM found f JOIN lut l USING (m, k) GROUP BY qid, vec_id"
    return f"WITH {sub_sql(source, parts, dimension)}, {book_sql()}, {assign_sql(train_by)}, {tables}, {top_sql(dist)}"


def exact_sql(source: str, by: str, name: str = "top") -> str:
    dist = f"SELECT q.vec_id AS qid, e.vec_id, round({dist_sql(by, 'e.v', 'q.v')}, 9) AS dist FROM e, e q WHERE q.vec_id % {STEP} = 0"
    return f"{source}, {top_sql(dist)}".replace("top AS", f"{name} AS")


def recall_sql(kind: str, tail: str) -> str:
    truth = exact_sql("", "l2sq", "truth").removeprefix(", ")
    first = "WHERE rank = 1" if kind == "first" else ""
    share = "CASE WHEN count(t.vec_id) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE" if kind == "any" else "CAST(count(t.vec_id) AS DOUBLE) / count(*)"
    return f"{adc_sql(DOUBLE, 'l2sq')}, {truth}, rec AS (SELECT w.qid, {share} AS recall FROM (SELECT * FROM truth {first}) w LEFT JOIN top t ON t.qid = w.qid AND t.vec_id = w.vec_id GROUP BY w.qid) {tail}"


def text_sql(c: str) -> str:
    return f"array_to_string(list_transform({c}, lambda x: CAST(x AS VARCHAR)), ',')"


CELLS = "c AS (SELECT vec_id, list_filter(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN i END), lambda i: i IS NOT NULL) AS cells FROM embeddings)"
CUSTOMERS = """q AS (SELECT o_custkey AS vec_id, l_partkey % 16 AS j, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
e AS (SELECT c.vec_id, list(coalesce(q.q, 0.0) ORDER BY t.j) AS v FROM (SELECT DISTINCT vec_id FROM q) c CROSS JOIN range(16) t(j) LEFT JOIN q ON q.vec_id = c.vec_id AND q.j = t.j GROUP BY c.vec_id)"""
#: Mirrored 3 x 3 neighbours: cells next to a border stand outside it, too.
EDGES = f"""WITH {CELLS}, a AS (SELECT vec_id, cell // 8 AS r, cell % 8 AS c FROM (SELECT vec_id, unnest(cells) AS cell FROM c)),
tall AS (SELECT * FROM a UNION ALL SELECT vec_id, -1, c FROM a WHERE r = 1 UNION ALL SELECT vec_id, 8, c FROM a WHERE r = 6),
wide AS (SELECT * FROM tall UNION ALL SELECT vec_id, r, -1 FROM tall WHERE c = 1 UNION ALL SELECT vec_id, r, 8 FROM tall WHERE c = 6),
w(n, e) AS (VALUES {", ".join(f"({n}, {list(e)})" for n, e in enumerate(descriptors.EDGE_KERNELS))}),
seen AS (SELECT vec_id, n, r - s // 3 + 1 AS r, c - s % 3 + 1 AS c, sum(255.0 * e[s + 1])::DOUBLE AS x FROM wide, range(9) t(s), w GROUP BY ALL),
h AS (SELECT vec_id, n * 16 + (r // 2) * 4 + c // 2 AS entry, sum(abs(x)) AS x FROM seen WHERE r BETWEEN 0 AND 7 AND c BETWEEN 0 AND 7 GROUP BY ALL)
SELECT vec_id, CAST(entry AS INTEGER) AS entry, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS x FROM h WHERE x <> 0"""
GRADIENTS = """WITH a AS (SELECT DISTINCT o_custkey AS vec_id, (l_partkey % 1764) // 42 AS r, (l_partkey % 1764) % 42 AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT vec_id, r, c - 1 AS c, 255.0 AS x, 0.0 AS y FROM a WHERE c BETWEEN 2 AND 41 UNION ALL SELECT vec_id, r, c + 1, -255.0, 0.0 FROM a WHERE c BETWEEN 0 AND 39
 UNION ALL SELECT vec_id, r - 1, c, 0.0, 255.0 FROM a WHERE r BETWEEN 2 AND 41 UNION ALL SELECT vec_id, r + 1, c, 0.0, -255.0 FROM a WHERE r BETWEEN 0 AND 39),
s AS (SELECT vec_id, r, c, sum(x)::DOUBLE AS x, sum(y)::DOUBLE AS y FROM g GROUP BY vec_id, r, c),
b AS (SELECT vec_id, ((r // 21) * 2 + c // 21) * 9 + (CAST(floor((degrees(atan2(y, x)) + 180) / 20) AS BIGINT)) % 9 AS entry, sqrt(x * x + y * y) AS m FROM s)
SELECT vec_id, CAST(entry AS INTEGER) AS entry, round(sum(m), 6) AS x FROM b WHERE m <> 0 GROUP BY vec_id, entry"""
_KEY = "vec_id, o, k, r, c"
_LEVELS = ", ".join(f"({o}, {step}, {n}, {k}, {v!r})" for o, step, n, _, variances in keypoints.octave_plan(8, KEYPOINT_OCTAVES) for k, v in enumerate(variances))
KEYPOINTS = f"""WITH {CELLS}, a AS (SELECT DISTINCT vec_id, cell // 8 AS y, cell % 8 AS x FROM (SELECT vec_id, unnest(cells) AS cell FROM c)),
lev(o, step, n, k, v) AS (VALUES {_LEVELS}),
l AS (SELECT vec_id, o, n, k, r, c, sum(exp(-((r * step - y) ** 2) / (2 * v)) / sqrt(2 * pi() * v) * exp(-((c * step - x) ** 2) / (2 * v)) / sqrt(2 * pi() * v)) AS x
 FROM a, lev, range(8) i(r), range(8) j(c) WHERE r < n AND c < n GROUP BY ALL),
d AS (SELECT p.vec_id, p.o, p.n, p.k, p.r, p.c, round(q.x - p.x, 9) AS d FROM l p JOIN l q ON p.vec_id = q.vec_id AND p.o = q.o AND p.r = q.r AND p.c = q.c AND q.k = p.k + 1),
e AS (SELECT p.vec_id, p.o, p.n, p.k, p.r, p.c, p.d, max(q.d) AS high, min(q.d) AS low,
 sum(CASE WHEN q.k = p.k AND q.r = p.r THEN q.d * (CASE WHEN q.c = p.c THEN -2 ELSE 1 END) ELSE 0 END) AS xx,
 sum(CASE WHEN q.k = p.k AND q.c = p.c THEN q.d * (CASE WHEN q.r = p.r THEN -2 ELSE 1 END) ELSE 0 END) AS yy,
 sum(CASE WHEN q.k = p.k THEN q.d * (q.r - p.r) * (q.c - p.c) / 4 ELSE 0 END) AS xy
 FROM d p JOIN d q ON p.vec_id = q.vec_id AND p.o = q.o AND abs(p.k - q.k) <= 1 AND abs(p.r - q.r) <= 1 AND abs(p.c - q.c) <= 1 WHERE p.k BETWEEN 1 AND 3 GROUP BY ALL),
kp AS (SELECT {_KEY}, 1.6 * 2 ** (k / 3.0) AS size FROM e WHERE least(r, c) >= {KEYPOINT_BORDER} AND greatest(r, c) < n - {KEYPOINT_BORDER}
 AND (d > 0 AND d = high OR d < 0 AND d = low) AND abs(d) >= 0.04 / 3 AND xx * yy - xy * xy > 0 AND (xx + yy) ** 2 * 10 < 121 * (xx * yy - xy * xy)),
g AS (SELECT p.vec_id, p.o, p.k, p.r, p.c, sum(CASE WHEN q.r = p.r THEN q.x * (q.c - p.c) ELSE 0 END) AS gx, sum(CASE WHEN q.c = p.c THEN q.x * (p.r - q.r) ELSE 0 END) AS gy
 FROM l p JOIN l q ON p.vec_id = q.vec_id AND p.o = q.o AND p.k = q.k AND abs(p.r - q.r) <= 1 AND abs(p.c - q.c) <= 1
 WHERE p.k BETWEEN 1 AND 3 AND least(p.r, p.c) >= 1 AND greatest(p.r, p.c) < p.n - 1 GROUP BY ALL),
patch AS (SELECT kp.*, (g.c - kp.c)::DOUBLE AS x, (kp.r - g.r)::DOUBLE AS y, sqrt(gx * gx + gy * gy) AS length, (degrees(atan2(gy, gx)) + 360) % 360 AS angle FROM kp JOIN g ON kp.vec_id = g.vec_id AND kp.o = g.o AND kp.k = g.k),
h AS (SELECT {_KEY}, CAST(floor(angle / 10 + 0.5) AS INTEGER) % 36 AS i, sum(length * exp(-(x * x + y * y) / (4.5 * size * size))) AS h FROM patch WHERE greatest(abs(x), abs(y)) <= round(4.5 * size) GROUP BY ALL),
f AS (SELECT kp.*, t.i, coalesce(h.h, 0) AS h FROM kp CROSS JOIN range(36) t(i) LEFT JOIN h USING ({_KEY}, i)),
s AS (SELECT p.vec_id, p.o, p.k, p.r, p.c, p.i, round(sum(q.h * [1, 4, 6, 4, 1][(q.i - p.i + 38) % 36 + 1]) / 16, 9) AS h
 FROM f p JOIN f q ON p.vec_id = q.vec_id AND p.o = q.o AND p.k = q.k AND p.r = q.r AND p.c = q.c AND (q.i - p.i + 38) % 36 < 5 GROUP BY ALL),
turns AS (SELECT p.vec_id, p.o, p.k, p.r, p.c, ((p.i + (a.h - b.h) / (2 * (a.h - 2 * p.h + b.h))) * 10 + 360) % 360 AS turn
 FROM (SELECT *, max(h) OVER (PARTITION BY {_KEY}) AS top FROM s) p
 JOIN s a ON p.vec_id = a.vec_id AND p.o = a.o AND p.k = a.k AND p.r = a.r AND p.c = a.c AND a.i = (p.i + 35) % 36
 JOIN s b ON p.vec_id = b.vec_id AND p.o = b.o AND p.k = b.k AND p.r = b.r AND p.c = b.c AND b.i = (p.i + 1) % 36 WHERE p.h > a.h AND p.h > b.h AND p.h >= 0.8 * p.top),
w AS (SELECT {_KEY}, turn, length, (x * cos(radians(turn)) + y * sin(radians(turn))) / (3 * size) AS u, (y * cos(radians(turn)) - x * sin(radians(turn))) / (3 * size) AS v,
 ((angle - turn + 360) % 360) / 45 AS b FROM patch JOIN turns USING ({_KEY})),
z AS (SELECT {_KEY}, turn, length * exp(-(u * u + v * v) / 8) AS x, u + 1.5 AS u, v + 1.5 AS v, b FROM w),
t AS (SELECT {_KEY}, turn, CAST(((floor(v) + j) * 4 + floor(u) + i) * 8 + (floor(b) + m) % 8 AS INTEGER) AS entry,
 sum(x * abs(1 - i - u + floor(u)) * abs(1 - j - v + floor(v)) * abs(1 - m - b + floor(b))) AS x FROM z, range(2) t1(i), range(2) t2(j), range(2) t3(m)
 WHERE floor(u) + i BETWEEN 0 AND 3 AND floor(v) + j BETWEEN 0 AND 3 GROUP BY ALL),
cutoff AS (SELECT {_KEY}, turn, entry, least(x / sqrt(sum(x * x) OVER (PARTITION BY {_KEY}, turn)), 0.2) AS x FROM t WHERE x > 0),
full_size AS (SELECT vec_id, entry, least(512 * x / sqrt(sum(x * x) OVER (PARTITION BY {_KEY}, turn)), 255) AS x FROM cutoff),
n AS (SELECT vec_id, count(*) AS n FROM turns GROUP BY vec_id)
SELECT vec_id, entry, round(sum(x) / any_value(n), 3) AS x FROM full_size JOIN n USING (vec_id) GROUP BY vec_id, entry HAVING round(sum(x) / any_value(n), 3) <> 0"""
BASE = f"WITH {sub_sql(DOUBLE)}, {book_sql()}, {assign_sql()}"
_SIGN16 = f"WITH {sub_sql(SIGNS, 16)}, {book_sql(4)}, points AS (SELECT m, sv, count(*) AS n FROM sub GROUP BY m, sv), {assign_sql('jaccard0', points='points')}"

SQL = {
    "pq_subvectors": f"WITH {sub_sql(DOUBLE)} SELECT vec_id, m, CAST(j - 1 AS INTEGER) AS j, round(x, 6) AS x FROM (SELECT vec_id, m, unnest(sv) AS x, generate_subscripts(sv, 1) AS j FROM sub)",
    "pq_init_codebook": f"WITH {sub_sql(DOUBLE)}, {book_sql()} {entries_sql('book')}",
    "pq_assign": f"{BASE} SELECT vec_id, m, k, round(d, 6) AS d FROM found",
    "pq_codes_packed": f"{BASE}, {codes_sql()} SELECT vec_id, {text_sql('codes')} AS codes FROM codes",
    "pq_centroid_update": f"{BASE}, {update_sql()} {entries_sql('means')}",
    "pq_lloyd_2iter": f"{BASE}, {update_sql()}, {assign_sql(book='means', name='found2')}, {update_sql('found2', 'means', 'means2')} {entries_sql('means2')}",
    "pq_quantization_error": f"{BASE} SELECT m, round(avg(d), 6) AS error FROM found GROUP BY m",
    "adc_topk_l2": f"{adc_sql(DOUBLE, 'l2sq')} {TOP_OUT}",
    "adc_long_l2": f"{adc_sql(DOUBLE, 'l2sq')} {TOP_OUT}",
    "adc_topk_l2_unsquared": f"{adc_sql(DOUBLE, 'l2')} {TOP_OUT}",
    "adc_topk_jaccard": f"{adc_sql(SIGNS, 'jaccard', 'jaccard')} {TOP_OUT}",
    "adc_topk_gjaccard": f"{adc_sql(SIZES, 'gjaccard', 'gjaccard')} {TOP_OUT}",
    "hamming_topk": f"{BASE}, {codes_sql()}, "
    + top_sql(f"SELECT q.vec_id AS qid, c.vec_id, CAST(len(list_filter(list_zip(c.codes, q.codes), lambda z: z[1] <> z[2])) AS DOUBLE) AS dist FROM codes c, codes q WHERE q.vec_id % {STEP} = 0")
    + f" {TOP_OUT}",
    "exact_topk_l2": f"WITH {exact_sql(DOUBLE, 'l2sq')} {TOP_OUT}",
    "exact_topk_jaccard": f"WITH {exact_sql(SIGNS, 'jaccard')} {TOP_OUT}",
    "exact_topk_gjaccard": f"WITH {exact_sql(SIZES, 'gjaccard')} {TOP_OUT}",
    "exact_topk_l2_unsquared": f"WITH {exact_sql(DOUBLE, 'l2')} {TOP_OUT}",
    "exact_topk_hamming": f"WITH {exact_sql(SIGNS, 'hamming')} {TOP_OUT}",
    "zorder_adc_topk": f"{adc_sql(ZORDERED, 'l2sq')} {TOP_OUT}",
    "recall_set": recall_sql("set", "SELECT qid, round(recall, 6) AS recall FROM rec"),
    "recall_anyhit": recall_sql("any", "SELECT qid, recall FROM rec"),
    "recall_first": recall_sql("first", "SELECT qid, round(recall, 6) AS recall FROM rec"),
    "recall_stats": recall_sql("set", "SELECT count(*) AS n_queries, round(avg(recall), 6) AS mean_recall, round(stddev_pop(recall), 6) AS sd_recall FROM rec"),
    "recall_histogram": recall_sql(
        "set",
        ", ends AS (SELECT CASE WHEN a = b THEN a - 0.5 ELSE a END AS a, CASE WHEN a = b THEN b + 0.5 ELSE b END AS b FROM (SELECT min(recall) AS a, max(recall) AS b FROM rec)),"
        " cnt AS (SELECT least(floor((recall - a) / (b - a) * 20), 19) AS bin, count(*) AS n FROM rec, ends GROUP BY 1)"
        " SELECT CAST(t.i AS INTEGER) AS bin, round(a + t.i * ((b - a) / 20), 6) AS lo, round(a + (t.i + 1) * ((b - a) / 20), 6) AS hi, coalesce(n, 0) AS n FROM ends CROSS JOIN range(20) t(i) LEFT JOIN cnt ON cnt.bin = t.i",
    ),
    "distances": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN abs(CAST(x AS DOUBLE)) > 0.1 THEN abs(CAST(x AS DOUBLE)) ELSE 0.0 END) AS v FROM embeddings) SELECT a.vec_id, "
    + ", ".join(f"round({dist_sql(by, 'a.v', 'b.v')}, 6) AS {name}" for by, name in (("l2sq", "l2sq"), ("l2", "l2"), ("jaccard", "jaccard"), ("jaccard", "set_jaccard"), ("weighted", "weighted"), ("gjaccard", "general")))
    + ", CAST(len(list_filter(list_zip(a.v, b.v), lambda z: z[1] <> z[2])) AS INTEGER) AS hamming FROM e a JOIN e b ON b.vec_id = a.vec_id + 1",
    "subvector_unique_profile": " UNION ALL ".join(f"(WITH {sub_sql(SIGNS, p)} SELECT {p} AS parts, m, count(DISTINCT sv) AS n_unique FROM sub GROUP BY m)" for p in profile.divisors(DIM)),
    "subvector_zero_profile": "WITH "
    + sub_sql("e AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0.2 THEN CAST(x AS DOUBLE) ELSE 0.0 END) AS v FROM embeddings)", 16)
    + ", cols AS (SELECT m, j, max(x <> 0) AS used FROM (SELECT m, unnest(sv) AS x, generate_subscripts(sv, 1) AS j FROM sub) GROUP BY m, j)"
    " SELECT m, (SELECT count(*) FROM cols WHERE cols.m = s.m AND NOT used) AS zero_columns, count(*) FILTER (len(list_filter(sv, lambda x: x <> 0)) = 0) AS zero_subvectors FROM sub s GROUP BY m",
    "sparse_cells": f"WITH {CELLS} SELECT vec_id, {text_sql('cells')} AS cells FROM c",
    "sparse_parts": f"WITH {CELLS} SELECT vec_id, CAST(m AS INTEGER) AS m, {text_sql('list_transform(list_filter(cells, lambda x: x // 8 = m), lambda x: x % 8)')} AS cells FROM c, range(8) t(m)",
    "dense_again": f"WITH {CELLS} SELECT vec_id, CAST(64 AS INTEGER) AS n, CAST(len(cells) AS DOUBLE) AS ones FROM c",
    "zorder_permutation": f"WITH {Z_ORDER.replace('{s}', '42').replace('{n}', '1764')}, a AS (SELECT DISTINCT o_custkey, l_partkey % 1764 AS cell FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
    " SELECT CAST(rank AS INTEGER) AS rank, CAST(cell AS INTEGER) AS cell, count(*) AS n FROM a JOIN z USING (cell) GROUP BY rank, cell",
    "zorder_sparse": f"WITH {CELLS}, {Z_ORDER.replace('{s}', '8').replace('{n}', '64')} SELECT vec_id, coalesce(string_agg(CAST(rank AS VARCHAR), ',' ORDER BY rank), '') AS cells FROM (SELECT vec_id, unnest(cells) AS cell FROM c) JOIN z USING (cell) GROUP BY vec_id",
    "autoscale": f"WITH {sub_sql(DOUBLE)}, x AS (SELECT vec_id, m, unnest(sv) AS x, generate_subscripts(sv, 1) AS j FROM sub), s AS (SELECT m, j, avg(x) AS a, stddev_pop(x) AS sd FROM x GROUP BY m, j)"
    " SELECT vec_id, m, CAST(j - 1 AS INTEGER) AS j, round(CASE WHEN sd = 0 THEN 0.0 ELSE (x - a) / sd END, 6) AS x FROM x JOIN s USING (m, j)",
    "kmedoid_snap": f"{BASE}, {update_sql()}, near AS (SELECT f.m, f.k, f.sv, row_number() OVER (PARTITION BY f.m, f.k ORDER BY {dist_sql('l2', 'f.sv', 'b.c')}, f.vec_id) AS r FROM found f JOIN means b ON b.m = f.m AND b.k = f.k),"
    " snap AS (SELECT b.m, b.k, coalesce(n.sv, b.c) AS c FROM means b LEFT JOIN (SELECT * FROM near WHERE r = 1) n ON n.m = b.m AND n.k = b.k) " + entries_sql("snap"),
    "exact_medoid": f"{_SIGN16}, tot AS (SELECT a.m, a.k, a.sv, sum({dist_sql('jaccard0', 'a.sv', 'b.sv')} * CASE WHEN a.sv = b.sv THEN b.n - 1 ELSE b.n END) AS t FROM found a JOIN found b ON a.m = b.m AND a.k = b.k GROUP BY a.m, a.k, a.sv),"
    " med AS (SELECT m, k, sv AS c FROM (SELECT *, row_number() OVER (PARTITION BY m, k ORDER BY round(t, 9), sv) AS r FROM tot) WHERE r = 1) " + entries_sql("med"),
    "dbscan_core_points": f"WITH {sub_sql(SIGNS)}, p AS (SELECT m, sv, count(*) AS n FROM sub GROUP BY m, sv) SELECT a.m, {text_sql('list_transform(a.sv, lambda x: CAST(x AS INTEGER))')} AS sv, CAST(sum(b.n) AS BIGINT) AS near"
    f" FROM p a JOIN p b ON a.m = b.m WHERE {dist_sql('jaccard0', 'a.sv', 'b.sv')} <= 0.3 GROUP BY a.m, a.sv HAVING sum(b.n) >= 5",
    "kmedoids_one_step": f"{_SIGN16}, tot AS (SELECT a.m, a.k, a.sv, sum({dist_sql('jaccard0', 'a.sv', 'b.sv')} * CASE WHEN a.sv = b.sv THEN b.n - 1 ELSE b.n END) AS t FROM found a JOIN found b ON a.m = b.m AND a.k = b.k GROUP BY a.m, a.k, a.sv),"
    f" med AS (SELECT m, k, sv AS c FROM (SELECT *, row_number() OVER (PARTITION BY m, k ORDER BY round(t, 9), sv) AS r FROM tot) WHERE r = 1), {assign_sql('jaccard0', 'med', 'coded')} SELECT vec_id, m, k, round(d, 6) AS d FROM coded",
    "model_search_2iter": f"WITH {sub_sql(DOUBLE, 4)}, {book_sql()}, {assign_sql()}, {update_sql()}, {assign_sql(book='means', name='found2')}, {update_sql('found2', 'means', 'means2')}, {assign_sql(book='means2', name='found3')},"
    f" lut AS (SELECT s.vec_id AS qid, s.m, b.k, {dist_sql('l2sq', 's.sv', 'b.c')} AS d FROM sub s JOIN means2 b USING (m) WHERE s.vec_id % {STEP} = 0),"
    f" {top_sql('SELECT qid, vec_id, round(list_sum(list(l.d ORDER BY m)), 9) AS dist FROM found3 f JOIN lut l USING (m, k) GROUP BY qid, vec_id')} {TOP_OUT}",
    "descriptor_edges": EDGES,
    "descriptor_gradients": GRADIENTS,
    "descriptor_keypoints": KEYPOINTS,
    "fix_dimension": f"WITH {DOUBLE} SELECT vec_id, CAST(80 AS INTEGER) AS n_long, CAST(48 AS INTEGER) AS n_short, round(list_sum(v), 6) AS sum_long, round(list_sum(v[1:48]), 6) AS sum_short FROM e",
    "customer_adc_gjaccard": f"{adc_sql(CUSTOMERS, 'gjaccard', 'gjaccard', 16, 4)} {TOP_OUT}",
}

# Sparse rasters: sets as lists of cells.
OVERLAP = "len(list_intersect({a}, {b}))"
SET_METRICS = {
    "jaccard": "CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE 1 - " + f"{OVERLAP} / (len({{a}}) + len({{b}}) - {OVERLAP})::DOUBLE END",
    "jaccard0": "CASE WHEN len({a}) + len({b}) = 0 THEN 0.0 ELSE 1 - " + f"{OVERLAP} / (len({{a}}) + len({{b}}) - {OVERLAP})::DOUBLE END",
    "l2sq": f"(len({{a}}) + len({{b}}) - 2 * {OVERLAP})::DOUBLE",
}
SUBSETS = f"""WITH a AS (SELECT DISTINCT o_custkey AS vec_id, l_partkey % {PARCEL} AS cell FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
own AS (SELECT vec_id, cell // {PARCEL // PARCEL_PARTS} AS m, list(CAST(cell % {PARCEL // PARCEL_PARTS} AS INTEGER) ORDER BY cell) AS cells FROM a GROUP BY vec_id, m),
sub AS MATERIALIZED (SELECT v.vec_id, CAST(t.m AS INTEGER) AS m, coalesce(own.cells, CAST([] AS INTEGER[])) AS cells FROM (SELECT DISTINCT vec_id FROM a) v CROSS JOIN range({PARCEL_PARTS}) t(m) LEFT JOIN own ON own.vec_id = v.vec_id AND own.m = t.m),
points AS MATERIALIZED (SELECT m, cells, count(*) AS n FROM sub GROUP BY m, cells),
book AS MATERIALIZED (SELECT m, CAST(k AS INTEGER) AS k, cells AS c FROM (SELECT m, cells, row_number() OVER (PARTITION BY m ORDER BY list_transform(cells, lambda x: -x)) - 1 AS k FROM points) WHERE k < {KS})"""


def set_dist(by: str, a: str, b: str) -> str:
    return SET_METRICS[by].replace("{a}", a).replace("{b}", b)


def nearest_set_sql(by: str) -> str:
    """The points with their nearest centroid."""
    return f"near AS MATERIALIZED (SELECT m, cells, n, best.k AS k FROM (SELECT p.m, p.cells, any_value(p.n) AS n, min({{'d': {set_dist(by, 'p.cells', 'b.c')}, 'k': b.k}}) AS best FROM points p JOIN book b ON b.m = p.m GROUP BY p.m, p.cells))"


def candidates_sql(ks: int, rounds: int = qz.ROUNDS) -> str:
    draw = lambda r: f"(CAST('0x' || substr(md5('0:{r}:' || m || ':' || c), 1, 8) AS BIGINT) + 1) / 4294967296.0::DOUBLE"
    parts = [
        f"WITH {sub_sql(DOUBLE)}, pts AS MATERIALIZED (SELECT m, sv, count(*) AS n, min(vec_id) AS c FROM sub GROUP BY m, sv)",
        f"new0 AS MATERIALIZED (SELECT m, c, sv FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY {draw(0)}, c) AS r FROM pts) WHERE r = 1)",
        f"near0 AS MATERIALIZED (SELECT p.*, f.c AS nearest, {dist_sql('l2sq', 'p.sv', 'f.sv')} AS d FROM pts p JOIN new0 f USING (m))",
    ]
    for r in range(1, rounds + 1):
        parts.append(f"new{r} AS MATERIALIZED (SELECT m, c, sv FROM (SELECT *, sum(n * d) OVER (PARTITION BY m) AS total FROM near{r - 1}) WHERE total > 0 AND {draw(r)} < 2.0 * {ks} * n * d / total)")
        best = f"SELECT p.m, p.c, min({{'d': {dist_sql('l2sq', 'p.sv', 'f.sv')}, 'k': f.c}}) AS best FROM near{r - 1} p JOIN new{r} f ON f.m = p.m GROUP BY p.m, p.c"
        parts.append(f"near{r} AS MATERIALIZED (SELECT p.m, p.sv, p.n, p.c, CASE WHEN best < {{'d': p.d, 'k': p.nearest}} THEN best.k ELSE p.nearest END AS nearest, CASE WHEN best.d < p.d THEN best.d ELSE p.d END AS d FROM near{r - 1} p LEFT JOIN ({best}) b ON b.m = p.m AND b.c = p.c)")
    return f"{', '.join(parts)} SELECT m, nearest AS vec_id, CAST(sum(n) AS BIGINT) AS weight FROM near{rounds} GROUP BY m, nearest"


def medoid_sql(found: str, name: str) -> str:
    return (
        f"{name}_t AS MATERIALIZED (SELECT a.m, a.k, a.sv, sum({dist_sql('jaccard0', 'a.sv', 'b.sv')} * CASE WHEN a.sv = b.sv THEN b.n - 1 ELSE b.n END) AS t FROM {found} a JOIN {found} b ON a.m = b.m AND a.k = b.k GROUP BY a.m, a.k, a.sv),"
        f" {name} AS MATERIALIZED (SELECT m, k, sv AS c FROM (SELECT *, row_number() OVER (PARTITION BY m, k ORDER BY round(t, 9), sv) AS r FROM {name}_t) WHERE r = 1)"
    )


SQL |= {
    "kmedoids_2iter": f"{_SIGN16}, {medoid_sql('found', 'med')}, {assign_sql('jaccard0', 'med', 'found2', 'points')}, {medoid_sql('found2', 'med2')}, {assign_sql('jaccard0', 'med2', 'coded')} SELECT vec_id, m, k, round(d, 6) AS d FROM coded",
    "vecs_round_trip": "WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, embedding FROM embeddings) SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS j, round(CAST(unnest(embedding) AS DOUBLE), 6) AS x FROM e",
    "sparse_adc_topk": f"{SUBSETS}, {nearest_set_sql('jaccard')}, lut AS (SELECT s.vec_id AS qid, s.m, b.k, {set_dist('jaccard', 's.cells', 'b.c')} AS d FROM sub s JOIN book b ON b.m = s.m WHERE s.vec_id % {STEP} = 0),"
    " found AS (SELECT s.vec_id, s.m, n.k FROM sub s JOIN near n ON n.m = s.m AND n.cells = s.cells), "
    + top_sql("SELECT qid, vec_id, round(list_sum(list(l.d ORDER BY m)), 9) AS dist FROM found f JOIN lut l USING (m, k) GROUP BY qid, vec_id")
    + f" {TOP_OUT}",
    "sparse_kmedoids_step": f"{SUBSETS}, {nearest_set_sql('jaccard0')}, tot AS (SELECT a.m, a.k, a.cells, sum({set_dist('jaccard0', 'a.cells', 'b.cells')} * CASE WHEN a.cells = b.cells THEN b.n - 1 ELSE b.n END) AS t FROM near a JOIN near b ON a.m = b.m AND a.k = b.k GROUP BY a.m, a.k, a.cells),"
    " med AS (SELECT m, k, cells FROM (SELECT *, row_number() OVER (PARTITION BY m, k ORDER BY round(t, 9), cells) AS r FROM tot) WHERE r = 1) SELECT m, k, unnest(cells) AS cell FROM med UNION ALL SELECT m, k, NULL FROM med WHERE len(cells) = 0",
    "sparse_means_step": f"{SUBSETS}, {nearest_set_sql('l2sq')}, sizes AS (SELECT m, k, sum(n) AS size FROM near GROUP BY m, k), cell AS (SELECT m, k, cell, sum(n) AS n FROM (SELECT m, k, n, unnest(cells) AS cell FROM near) GROUP BY m, k, cell)"
    " SELECT m, k, cell, round(n / size::DOUBLE, 6) AS weight FROM cell JOIN sizes USING (m, k)",
    "kmeans_parallel_candidates": candidates_sql(KS),
    "dbscan_codebook": f"WITH RECURSIVE {sub_sql(SIGNS)}, p AS MATERIALIZED (SELECT m, sv, count(*) AS n FROM sub GROUP BY m, sv),"
    f" pairs AS MATERIALIZED (SELECT a.m, a.sv AS a, b.sv AS b, b.n AS nb FROM p a JOIN p b ON a.m = b.m WHERE {dist_sql('jaccard0', 'a.sv', 'b.sv')} <= 0.3),"
    " cores AS MATERIALIZED (SELECT m, a AS sv FROM pairs GROUP BY m, a HAVING sum(nb) >= 5),"
    " edges AS MATERIALIZED (SELECT e.m, e.a, e.b FROM pairs e JOIN cores x ON x.m = e.m AND x.sv = e.a JOIN cores y ON y.m = e.m AND y.sv = e.b),"
    " reach AS (SELECT m, a, b FROM edges UNION SELECT r.m, r.a, e.b FROM reach r JOIN edges e ON e.m = r.m AND e.a = r.b),"
    " label AS (SELECT m, a AS sv, min(b) AS label FROM reach GROUP BY m, a),"
    " border AS (SELECT e.m, e.a AS sv, min(l.label) AS label FROM pairs e JOIN label l ON l.m = e.m AND l.sv = e.b GROUP BY e.m, e.a),"
    " found AS MATERIALIZED (SELECT b.m, b.sv, p.n, CAST(dense_rank() OVER (PARTITION BY b.m ORDER BY label) - 1 AS INTEGER) AS k FROM border b JOIN p ON p.m = b.m AND p.sv = b.sv),"
    f" tot AS (SELECT a.m, a.k, a.sv, sum({dist_sql('jaccard0', 'a.sv', 'b.sv')} * CASE WHEN a.sv = b.sv THEN b.n - 1 ELSE b.n END) AS t FROM found a JOIN found b ON a.m = b.m AND a.k = b.k GROUP BY a.m, a.k, a.sv),"
    " med AS (SELECT m, k, sv AS c FROM (SELECT *, row_number() OVER (PARTITION BY m, k ORDER BY round(t, 9), sv) AS r FROM tot) WHERE r = 1 UNION ALL SELECT m, 0, min(sv) FROM p WHERE m NOT IN (SELECT m FROM found) GROUP BY m) " + entries_sql("med"),
}
