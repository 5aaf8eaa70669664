"""Recall of searches against ground truth, and its statistics.

found is (qid, rank, vec_id, ...), truth is (qid, neighbors); queries without
neighbours don't count, queries without results have recall 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _hits(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    want = truth.where(F.size("neighbors") > 0).select("qid", F.array_distinct("neighbors").alias("neighbors"))
    pairs = want.select("qid", F.explode("neighbors").alias("vec_id"))
    hit = found.where(F.col("rank") <= k).select("qid", "vec_id").distinct().join(pairs, ["qid", "vec_id"]).groupBy("qid").agg(F.count("*").alias("hits"))
    return want.select("qid", F.size("neighbors").alias("size")).join(hit, "qid", "left").select("qid", "size", F.coalesce("hits", F.lit(0)).alias("hits"))


def set_recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall): the share of a query's neighbours among its k results."""
    return _hits(found, truth, k).select("qid", (F.col("hits") / F.col("size")).alias("recall"))


def any_recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall): 1 if any neighbour is among the k results."""
    return _hits(found, truth, k).select("qid", F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("recall"))


def first_recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall): 1 if the first neighbour is among the k results."""
    first = truth.where(F.size("neighbors") > 0).select("qid", F.slice("neighbors", 1, 1).alias("neighbors"))
    return set_recall(found, first, k)


def recall_stats(recalls: DataFrame) -> DataFrame:
    """One row: queries, mean and population standard deviation."""
    return recalls.agg(F.count("*").alias("n_queries"), F.avg("recall").alias("mean_recall"), F.stddev_pop("recall").alias("sd_recall"))


def latency_stats(found: DataFrame) -> DataFrame:
    """One row from a timed search: queries, mean, median and 99th percentile (from a mergeable sketch) of their seconds."""
    each = found.groupBy("qid").agg(F.first("seconds").alias("seconds"))
    quantile = lambda q: F.percentile_approx("seconds", q, F.lit(10_000))
    return each.agg(F.count("*").alias("n_queries"), F.avg("seconds").alias("mean_seconds"), quantile(0.5).alias("median_seconds"), quantile(0.99).alias("p99_seconds"))


def histogram(values: DataFrame, column: str = "recall", bins: int = 20) -> DataFrame:
    """(bin, lo, hi, n) of equal bins between the data's ends, the last one closed; empty bins included.

    Equal data are spread over one unit around them.
    """
    ends = values.agg(F.min(column).alias("a"), F.max(column).alias("b")).where("a is not null")
    ends = ends.select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    grid = ends.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    step = (F.col("b") - F.col("a")) / bins
    # `ends` is one row by construction.
    counted = values.join(F.broadcast(ends)).groupBy(F.least(F.floor((F.col(column) - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return grid.join(counted, "bin", "left").select("bin", (F.col("a") + F.col("bin") * step).alias("lo"), (F.col("a") + (F.col("bin") + 1) * step).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def with_truth(queries: DataFrame, truth: DataFrame) -> DataFrame:
    """The queries (qid, ...) that have ground truth."""
    return queries.join(truth.where(F.size("neighbors") > 0).select("qid"), "qid", "left_semi")


def valid_truth(truth: DataFrame, ids: DataFrame) -> DataFrame:
    """Ground truth without neighbours that are no vec_id of ids; emptied rows go, order stays."""
    rows = truth.select("qid", F.posexplode("neighbors").alias("at", "vec_id")).join(ids.select("vec_id"), "vec_id", "left_semi")
    return rows.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "vec_id"))), lambda e: e["vec_id"]).alias("neighbors"))


def truth_of(found: DataFrame) -> DataFrame:
    """Ground truth made from an exact search's results."""
    return found.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda e: e["vec_id"]).alias("neighbors"))
