"""The corpus pipeline: each stage reads the documents that the one before has kept.

Stages take (spark, docs, sf_dir) and return DataFrames; all but the last keep
the columns of docs, and the last emits the mixed corpus, one row per copy.
run() writes each stage as Parquet to the shared folder, reads it again for the
next, and deletes what is read no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, jaccard, mixing, quality, templates
from tessera.llm.shared import remove, scratch, shared_dir, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this table's labels, scores 0.5 or more."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates."""
    return templates.dedupe_lines(spark, docs, templates.free_name("n_dropped", docs.columns)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingle Jaccard of 0.75 or more: that of the smallest doc_id.

    Different texts of one doc_id are documents of their own; equal rows are one; rows without words all stay.
    """
    return jaccard.representatives(spark, docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean_documents(spark, docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: each document once per copy that the mix takes, with its copy number, and none without copies."""
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: Training a boosted model is no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages before the mix have kept."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = shared_dir(spark)
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STAGES[-1][1](spark, kept(spark, sf_dir), sf_dir)
