"""Queries through files and models that are written and read back, and trainings at fixed steps, with their SQL.

Files are written below spark.checkpoint.dir from whole tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as vc
from ..operators import evaluate, medoids, search
from ..operators import quantize as qz
from ..operators.lineage import cut, shared_path
from ..sources import text, vecs
from . import queries as base
from .model import PQModel
from .queries import DIM, DOUBLE, KS, PARTS, SIGNS, STEP, TOP, as_queries, embeddings, entries, rounded, shown, signs, subs

FIRST_N = 100  # rows of a file, where a limit of rows is what is asked for
FAR = 1000.0  # the entries of a centroid that has no members


def _entries_of(vectors: DataFrame, of: Column) -> DataFrame:
    return vectors.select("vec_id", F.posexplode("embedding").alias("j", "x")).select("vec_id", "j", of.alias("x"))


def dense_text_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings as lines of numbers, read back by suffix and numbered over the files."""
    path = shared_path(spark)
    text.write_dense(embeddings(spark, sf), path)
    return _entries_of(text.load_vectors(spark, path, "txt"), rounded(F.col("x").cast("double")))


def sparse_text_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The cells of binarised embeddings as lines, read back and numbered."""
    path = shared_path(spark)
    text.write_sparse(base.cells_of(spark, sf), path)
    return text.load_vectors(spark, path, "txt", DIM, sparse=True).select("vec_id", base.text("cells").alias("cells"))


def int_vecs_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings in steps of 1/256 as an ivecs folder, and modulo 256 as a bvecs folder, read by byte ranges."""
    steps = embeddings(spark, sf).withColumn("embedding", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("int")))
    found = None
    for kind, values in (("ivecs", steps), ("bvecs", steps.withColumn("embedding", F.transform("embedding", lambda x: F.pmod(x, F.lit(256)))))):
        path = shared_path(spark)
        vecs.write_vecs(values, path, kind)
        rows = _entries_of(vecs.numbered(vecs.read_vecs(spark, path, kind)), F.col("x").cast("long")).select(F.lit(kind).alias("kind"), "vec_id", "j", "x")
        found = rows if found is None else found.unionByName(rows)
    return found


def mixed_folder(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors of a folder that holds even rows as fvecs and odd ones as text, without their numbers, which follow file names."""
    path, vectors = shared_path(spark), embeddings(spark, sf)
    vecs.write_vecs(vectors.where("vec_id % 2 = 0"), path)
    text.write_dense(vectors.where("vec_id % 2 = 1"), path)
    back = text.load_folder(spark, path)
    return back.select(base.text(F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long"))).alias("vector"))


def first_rows_of_files(spark: SparkSession, sf: str) -> DataFrame:
    """The first FIRST_N vectors of a folder of fvecs files; the source reads no others."""
    vecs.register(spark)
    path = shared_path(spark)
    vecs.write_vecs(embeddings(spark, sf), path)
    return _entries_of(text.first_rows(spark.read.format("vecs").option("kind", "fvecs").load(path), FIRST_N), rounded(F.col("x").cast("double")))


def _named_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(file, pos, source_id): the vectors as rows of 97 files with numbers in their names, less those of excluded names."""
    name = F.concat(F.lit("rasters/part_"), (F.col("vec_id") % 97) * 500 + 3, F.lit(".txt"))
    rows = embeddings(spark, sf).select(name.alias("file"), F.floor(F.col("vec_id") / 97).alias("pos"), F.col("vec_id").alias("source_id"))
    return rows.where(~text.file_name(F.col("file")).rlike(text.OVER_40000))


def query_files(spark: SparkSession, sf: str) -> DataFrame:
    """Query numbers of the rows of files whose number says that they hold queries."""
    return text.query_files(_named_rows(spark, sf)).select("qid", "query_offset", "source_id")


def numbered_files(spark: SparkSession, sf: str) -> DataFrame:
    """Rows numbered over files in the order of the numbers in their names."""
    return vecs.numbered(_named_rows(spark, sf), "number").select("vec_id", "source_id")


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    vectors = embeddings(spark, sf)
    return evaluate.truth_of(search.exact_topk(vectors, as_queries(vectors), TOP))


def ground_truth_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """True neighbours through text files: a second line of a query replaces the first, neighbours that no vector is go, and so do queries without any left."""
    path, vectors = shared_path(spark), embeddings(spark, sf)
    wrong = lambda x: x + 1_000_000_000
    true = F.when(F.col("qid") % (3 * STEP) == 0, F.transform("neighbors", wrong)).otherwise(F.concat("neighbors", F.array(wrong(F.col("qid")))))
    line = lambda v, row: F.struct(F.lit(v).alias("v"), F.array_join(F.concat(F.array(F.col("qid").cast("string"), F.lit("none")), F.transform(row, lambda x: x.cast("string"))), " , ").alias("value"))
    lines = _truth(spark, sf).select("qid", F.explode(F.array(line(0, F.array(F.col("qid") + 1)), line(1, true))).alias("l"))
    lines.orderBy("qid", "l.v").select("l.value").write.text(path)
    valid = cut(evaluate.valid_truth(text.read_ground_truth(spark, path), vectors))
    asked = evaluate.with_truth(as_queries(vectors), valid).select("qid")
    return asked.join(valid, "qid").select("qid", base.text("neighbors").alias("neighbors"))


def ground_truth_files(spark: SparkSession, sf: str) -> DataFrame:
    """True neighbours as lines and, as rows without a query's number, as ivecs; both read back."""
    lines, matrix, truth = shared_path(spark), shared_path(spark), cut(_truth(spark, sf))
    text.write_ground_truth(truth, lines)
    vecs.write_vecs(truth.select(F.col("qid").alias("vec_id"), "neighbors"), matrix, "ivecs", "neighbors")
    rows = text.ground_truth_matrix(vecs.numbered(vecs.read_vecs(spark, matrix, "ivecs")))
    both = text.read_ground_truth(spark, lines).select(F.lit("lines").alias("kind"), "qid", "neighbors").unionByName(rows.select(F.lit("matrix").alias("kind"), "qid", "neighbors"))
    return both.select("kind", "qid", base.text("neighbors").alias("neighbors"))


def saved_model_search(spark: SparkSession, sf: str) -> DataFrame:
    """Search by a model that was saved after two Lloyd steps and loaded again."""
    vectors, path = embeddings(spark, sf), shared_path(spark)
    sub = vc.subvectors(vectors, 4, DIM)
    PQModel(DIM, parts=4, ks=KS, codebook=qz.lloyd(sub, qz.first_centroids(sub, KS), 2)).save(path)
    model = PQModel.load(spark, path)
    return shown(model.search(model.encode(vectors), as_queries(vectors), TOP))


def recall_2iter(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of the true nearest among the first 100 by codes of 8 x 4 bits, after two Lloyd steps."""
    vectors, sub = embeddings(spark, sf), subs(spark, sf)
    model = PQModel(DIM, parts=PARTS, ks=KS, codebook=qz.lloyd(sub, qz.first_centroids(sub, KS), 2))
    found = model.search(model.encode(vectors), as_queries(vectors), 100)
    return evaluate.set_recall(found, _truth(spark, sf), 100).select("qid", rounded("recall").alias("recall"))


def assign_ties_high(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of binarised subvectors where the last of equally near centroids is taken."""
    sub = vc.subvectors(signs(spark, sf), PARTS, DIM)
    return qz.assign(sub, cut(qz.first_centroids(sub, KS)), "l2sq", ties_high=True).select("vec_id", "m", "k", rounded("d").alias("d"))


def empty_cluster_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Centroids after an update in which one has no members, under each rule for those."""
    sub = subs(spark, sf)
    first = qz.first_centroids(sub, KS)
    lost = first.where("k = 0").select("m", F.lit(KS).alias("k"), F.array_repeat(F.lit(FAR), DIM // PARTS).alias("centroid"))
    book = cut(first.unionByName(lost))
    found = cut(qz.assign(sub, book))
    books = [entries(qz.updated_centroids(found, book, rule)).withColumn("rule", F.lit(rule)) for rule in ("keep", "zeros", "farthest")]
    return books[0].unionByName(books[1]).unionByName(books[2])


def snapped_2iter(spark: SparkSession, sf: str) -> DataFrame:
    """Centroids after two steps of means, each replaced by its nearest member."""
    sub = cut(subs(spark, sf))
    book = cut(qz.first_centroids(sub, KS))
    for _ in range(2):
        found = cut(qz.assign(sub, book, "l2"))
        book = cut(medoids.snapped(found, qz.updated_centroids(found, book), "l2"))
    return entries(book)


def midranges(sv: Column) -> Column:
    """A user's centroid: the middle between the ends of each entry."""
    return F.array(*[(F.min(F.get(sv, F.lit(j))) + F.max(F.get(sv, F.lit(j)))) / 2 for j in range(DIM)])


def kmeans_midrange_2iter(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of whole vectors, some of them null, after two steps with a user's centroid."""
    vectors = embeddings(spark, sf)
    points = vectors.select("vec_id", F.when(F.col("vec_id") % 7 != 3, F.col("embedding")).alias("point"))
    # The start is KS rows by definition; the window numbers those.
    draw = F.md5(F.col("vec_id").cast("string"))
    start = cut(vectors.orderBy(draw).limit(KS))
    centers = cut(start.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(draw)) - 1).alias("k"), F.col("embedding").alias("center")))
    done = qz.kmeans(points, centers, max_steps=2, by="l2sq", empty="keep", centroid=midranges)
    return done.codes.select("vec_id", "k")


@search.of_rows
def manhattan(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """A user's metric, of all rows of a matrix to a query."""
    return np.abs(rows.astype(float) - query.astype(float)).sum(-1)


def exact_topk_user(spark: SparkSession, sf: str) -> DataFrame:
    """Exact search by a metric of the user's."""
    vectors = embeddings(spark, sf)
    return shown(search.exact_topk(vectors, as_queries(vectors), TOP, manhattan))


QUERIES = {
    f.__name__: f
    for f in (
        dense_text_round_trip, sparse_text_round_trip, int_vecs_round_trip, mixed_folder, first_rows_of_files, query_files, numbered_files, ground_truth_round_trip,
        ground_truth_files, saved_model_search, recall_2iter, assign_ties_high, empty_cluster_rules, snapped_2iter, kmeans_midrange_2iter, exact_topk_user,
    )
}

# ---------------------------------------------------------------- SQL

_TRUE = base.exact_sql("", "l2sq", "truth").removeprefix(", ")
_NEAR = f"WITH {DOUBLE}, {_TRUE}"
_FILES = "r AS (SELECT vec_id AS source_id, (vec_id % 97) * 500 + 3 AS n, vec_id // 97 AS pos FROM embeddings), kept AS (SELECT * FROM r WHERE n < 40000)"
_ROWS = "WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, embedding FROM embeddings)"
_STEPS = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"


def _ints(kind: str, values: str) -> str:
    return f"SELECT '{kind}' AS kind, vec_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS j, unnest(v) AS x FROM (SELECT vec_id, {values} AS v FROM e)"


def snap_sql(found: str, means: str, name: str) -> str:
    near = f"SELECT f.m, f.k, f.sv, row_number() OVER (PARTITION BY f.m, f.k ORDER BY {base.dist_sql('l2', 'f.sv', 'b.c')}, f.vec_id) AS r FROM {found} f JOIN {means} b ON b.m = f.m AND b.k = f.k"
    return f"{name} AS (SELECT b.m, b.k, coalesce(n.sv, b.c) AS c FROM {means} b LEFT JOIN (SELECT * FROM ({near}) WHERE r = 1) n ON n.m = b.m AND n.k = b.k)"


def midrange_sql(found: str, book: str, name: str) -> str:
    entry = f"(SELECT m, k, j, (min(x) + max(x)) / 2 AS x FROM (SELECT m, k, unnest(sv) AS x, generate_subscripts(sv, 1) AS j FROM {found}) GROUP BY m, k, j)"
    return f"{name} AS MATERIALIZED (SELECT b.m, b.k, coalesce(a.c, b.c) AS c FROM {book} b LEFT JOIN (SELECT m, k, list(x ORDER BY j) AS c FROM {entry} GROUP BY m, k) a ON a.m = b.m AND a.k = b.k)"


_LOST = f"{base.book_sql(name='own')}, book AS (SELECT * FROM own UNION ALL SELECT m, {KS}, list_transform(c, lambda x: CAST({FAR} AS DOUBLE)) FROM own WHERE k = 0)"
_RULES = {
    "keep": "means",
    "zeros": f"(SELECT m, k, CASE WHEN k = {KS} THEN list_transform(c, lambda x: 0.0::DOUBLE) ELSE c END AS c FROM means)",
    "farthest": f"(SELECT a.m, a.k, CASE WHEN a.k = {KS} THEN far.sv ELSE a.c END AS c FROM means a JOIN (SELECT m, sv FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY d DESC, vec_id) AS r FROM found) WHERE r = 1) far ON far.m = a.m)",
}
_TWO = f"{base.assign_sql()}, {base.update_sql()}, {base.assign_sql(book='means', name='found2')}, {base.update_sql('found2', 'means', 'means2')}, {base.assign_sql(book='means2', name='found3')}"

SQL = {
    "dense_text_round_trip": base.SQL["vecs_round_trip"],
    "sparse_text_round_trip": f"WITH {base.CELLS} SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, {base.text_sql('cells')} AS cells FROM c WHERE len(cells) > 0",
    "int_vecs_round_trip": f"{_ROWS} {_ints('ivecs', _STEPS)} UNION ALL {_ints('bvecs', f'list_transform({_STEPS}, lambda x: ((x % 256) + 256) % 256)')}",
    "mixed_folder": f"SELECT {base.text_sql('list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT))')} AS vector FROM embeddings",
    "first_rows_of_files": f"{base.SQL['vecs_round_trip']} WHERE vec_id < {FIRST_N}",
    "query_files": f"WITH {_FILES} SELECT n + pos AS qid, n AS query_offset, source_id FROM kept WHERE n >= {text.FIRST_QUERY}",
    "numbered_files": f"WITH {_FILES}, f AS (SELECT n, max(pos) + 1 AS size FROM kept GROUP BY n), o AS (SELECT n, coalesce(sum(size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM f)"
    " SELECT CAST(first + pos AS BIGINT) AS vec_id, source_id FROM kept JOIN o USING (n)",
    "ground_truth_round_trip": f"{_NEAR} SELECT qid, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY rank) AS neighbors FROM truth WHERE qid % {3 * STEP} <> 0 GROUP BY qid",
    "ground_truth_files": f"{_NEAR}, t AS (SELECT qid, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY rank) AS neighbors FROM truth GROUP BY qid)"
    " SELECT 'lines' AS kind, qid, neighbors FROM t UNION ALL SELECT 'matrix', row_number() OVER (ORDER BY qid) - 1, neighbors FROM t",
    "saved_model_search": base.SQL["model_search_2iter"],
    "recall_2iter": f"WITH {base.sub_sql(DOUBLE)}, {base.book_sql()}, {_TWO}, lut AS (SELECT s.vec_id AS qid, s.m, b.k, {base.dist_sql('l2sq', 's.sv', 'b.c')} AS d FROM sub s JOIN means2 b USING (m) WHERE s.vec_id % {STEP} = 0), "
    + base.top_sql("SELECT qid, vec_id, round(list_sum(list(l.d ORDER BY m)), 9) AS dist FROM found3 f JOIN lut l USING (m, k) GROUP BY qid, vec_id", 100)
    + f", {_TRUE} SELECT w.qid, round(CAST(count(t.vec_id) AS DOUBLE) / count(*), 6) AS recall FROM truth w LEFT JOIN top t ON t.qid = w.qid AND t.vec_id = w.vec_id GROUP BY w.qid",
    "assign_ties_high": f"WITH {base.sub_sql(SIGNS)}, {base.book_sql()}, {base.assign_sql().replace(', b.k) AS r', ', b.k DESC) AS r')} SELECT vec_id, m, k, round(d, 6) AS d FROM found",
    "empty_cluster_rules": f"WITH {base.sub_sql(DOUBLE)}, {_LOST}, {base.assign_sql()}, {base.update_sql()} "
    + " UNION ALL ".join(f"SELECT m, k, CAST(j - 1 AS INTEGER) AS j, round(x, 6) AS x, '{rule}' AS rule FROM (SELECT m, k, unnest(c) AS x, generate_subscripts(c, 1) AS j FROM {rows})" for rule, rows in _RULES.items()),
    "snapped_2iter": f"WITH {base.sub_sql(DOUBLE)}, {base.book_sql()}, {base.assign_sql('l2')}, {base.update_sql()}, {snap_sql('found', 'means', 'snap')}, {base.assign_sql('l2', 'snap', 'found2')}, {base.update_sql('found2', 'snap', 'means2')}, {snap_sql('found2', 'means2', 'snap2')} "
    + base.entries_sql("snap2"),
    "kmeans_midrange_2iter": f"WITH {DOUBLE}, book AS (SELECT 0 AS m, CAST(k AS INTEGER) AS k, v AS c FROM (SELECT v, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR))) - 1 AS k FROM e) WHERE k < {KS}), sub AS (SELECT vec_id, 0 AS m, v AS sv FROM e WHERE vec_id % 7 <> 3),"
    f" {base.assign_sql()}, {midrange_sql('found', 'book', 'mid')}, {base.assign_sql(book='mid', name='found2')}, {midrange_sql('found2', 'mid', 'mid2')}, {base.assign_sql(book='mid2', name='found3')}"
    " SELECT e.vec_id, coalesce(f.k, -1) AS k FROM e LEFT JOIN found3 f USING (vec_id)",
    "exact_topk_user": f"WITH {DOUBLE}, {base.top_sql(f'SELECT q.vec_id AS qid, e.vec_id, round(list_sum(list_transform(list_zip(e.v, q.v), lambda z: abs(z[1] - z[2]))), 9) AS dist FROM e, e q WHERE q.vec_id % {STEP} = 0')} {base.TOP_OUT}",
}
