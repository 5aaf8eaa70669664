"""Searches whose queries are sent, and whose queries meet the rows in blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import metrics as mt
from tessera.operators import evaluate, search
from tessera.plans.model import PQModel


def data(spark, n=90, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(np.abs(rng.normal(size=(n, 6))) * (rng.random((n, 6)) < 0.6), 2)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())], "vec_id long, embedding array<double>").repartition(3)


def rows_of(found):
    return sorted((r.qid, r.rank, r.vec_id, r.dist) for r in found.collect())


@pytest.mark.parametrize("by", ["l2sq", "l2", "jaccard", "jaccard0", "weighted_jaccard", "gjaccard", "hamming"])
def test_exact_search_by_every_metric(spark, by):
    _, rows = data(spark)
    queries = rows.where("vec_id < 4").select(F.col("vec_id").alias("qid"), "embedding")
    to = mt.metric(by)(F.col("embedding"), F.col("q")).cast("double")
    pairs = rows.join(queries.select("qid", F.col("embedding").alias("q"))).select("qid", "vec_id", F.round(to, search.DIGITS).alias("dist"))
    assert rows_of(search.exact_topk(rows, queries, 9, by)) == rows_of(search.top_k(pairs, 9))


def test_exact_search_by_a_function(spark):
    x, rows = data(spark)
    queries = rows.where("vec_id = 3").select(F.col("vec_id").alias("qid"), "embedding")
    got = [r.vec_id for r in search.exact_topk(rows, queries, 5, lambda a, b: np.abs(a - b).max()).orderBy("rank").collect()]
    assert got == np.lexsort((np.arange(90), np.round(np.abs(x - x[3]).max(1), 9)))[:5].tolist()
    with pytest.raises(ValueError, match="unknown metric"):
        search.exact_topk(rows, queries, 5, "nothing")


def test_a_function_of_all_rows_is_called_once_for_many(spark):
    _, rows = data(spark)
    queries = rows.where("vec_id < 3").select(F.col("vec_id").alias("qid"), "embedding")
    calls = spark.sparkContext.accumulator(0)

    @search.of_rows
    def far(some, query):
        calls.add(1)
        return np.abs(some - query).max(-1)

    assert rows_of(search.exact_topk(rows, queries, 5, far)) == rows_of(search.exact_topk(rows, queries, 5, lambda a, b: np.abs(a - b).max()))
    assert 0 < calls.value < 91


def test_long_codes_are_scanned_without_a_row_for_each_pair(spark):
    rng = np.random.default_rng(8)
    codes = spark.createDataFrame([(v, m, int(rng.integers(5, 9))) for v in range(60) for m in (1, 4, 7) if (v + m) % 11], "vec_id long, m int, k int").unionByName(spark.createDataFrame([(99, 1, 77)], "vec_id long, m int, k int"))
    whole = [(q, m, k, round(float(rng.integers(0, 4)) / 3, 3)) for q in range(4) for m in (1, 4, 7) for k in range(5, 9)]
    for some in (whole, whole[:-1]):
        tables = spark.createDataFrame(some, "qid long, m int, k int, d double")
        want = search.top_k(codes.join(tables, ["m", "k"]).groupBy("qid", "vec_id").agg(F.round(F.sum("d"), 9).alias("dist")), 6)
        found = search.adc_long(codes, tables, 6)
        assert rows_of(found) == rows_of(want)
        assert ("MapInArrow" in found._jdf.queryExecution().executedPlan().toString()) == (some is whole)


@pytest.mark.parametrize("at_once", [1 << 18, 50])
def test_equal_codes_are_looked_up_once(spark, monkeypatch, at_once):
    rng = np.random.default_rng(9)
    x, tables = rng.integers(0, 3, (500, 4)), np.round(rng.integers(0, 3, (5, 4, 3)) / 7, 3)
    codes = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(rng.permutation(500), x, strict=True)], "vec_id long, codes array<int>").repartition(2)
    luts = spark.createDataFrame([(q, t.tolist()) for q, t in enumerate(tables)], "qid long, lut array<array<double>>")
    pairs = codes.join(luts).select("qid", "vec_id", F.round(sum(F.element_at(F.element_at("lut", m + 1), F.element_at("codes", m + 1) + 1) for m in range(4)), 9).alias("dist"))
    monkeypatch.setattr(search, "CODES_AT_ONCE", at_once)
    assert rows_of(search.adc_topk(codes, luts, 7)) == rows_of(search.top_k(pairs, 7))
    held = search._Codes(np.arange(500), x, list(tables[0]), 7)
    assert len(held.codes) <= 81 and len(held.near(list(tables[0]), np.inf)[0]) < 500


@pytest.mark.parametrize("row_bytes", [128 << 20, 2000])
def test_blocks_find_what_a_scan_finds(spark, monkeypatch, row_bytes):
    _, rows = data(spark)
    queries = rows.where("vec_id % 3 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    model = PQModel(6, parts=3, ks=8, max_steps=2).fit(rows)
    codes = model.encode(rows)
    searches = [lambda: search.exact_topk(rows, queries, 4), lambda: model.search(codes, queries, 4), lambda: model.search(codes, queries, 4, "hamming")]
    want = [rows_of(s()) for s in searches]
    monkeypatch.setattr(search, "BLOCK_BYTES", 500)
    monkeypatch.setattr(search, "ROW_BLOCK_BYTES", row_bytes)
    assert [rows_of(s()) for s in searches] == want
    plan = searches[0]()._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "Join" not in plan


def test_seconds_of_each_query(spark, monkeypatch):
    _, rows = data(spark)
    queries = rows.where("vec_id < 6").select(F.col("vec_id").alias("qid"), "embedding")
    for size in (search.BLOCK_BYTES, 100):
        monkeypatch.setattr(search, "BLOCK_BYTES", size)
        found = search.exact_topk(rows, queries, 3, timed=True)
        assert rows_of(found) == rows_of(search.exact_topk(rows, queries, 3))
        each = {r.qid: r.seconds for r in found.collect()}
        assert len(each) == 6 and all(0 < s < 5 for s in each.values())
        stats = evaluate.latency_stats(found).first()
        assert stats.n_queries == 6 and 0 < stats.median_seconds <= stats.p99_seconds and stats.mean_seconds > 0
