"""Text inputs: dense and sparse vectors, ground truth, and folders of mixed files.

Files are read in splits.  Lines are numbered within their split, then, by a table
of one row a split, within their file; `vecs.numbered` turns that into vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import parse_cells
from .vecs import KINDS, numbered, read_vecs

#: Numbers in file names above which files are left out, and from which they hold queries.
OVER_40000 = r"^.*_(?:[4-9]\d{4}|\d{6,}).*$"
FIVE_DIGITS = r"^.*_(?:[1-9][0-9]\d{3}).*$"
FIRST_QUERY = 24915


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, block, line) with `at`, their number in their split, whose lines come one after the other."""
    last, n = None, 0
    for batch in batches:
        at = np.zeros(batch.num_rows, np.int64)
        for k, split in enumerate(zip(batch["file"].to_pylist(), batch["block"].to_pylist(), strict=True)):
            n = n + 1 if split == last else 0
            last, at[k] = split, n
        yield pa.RecordBatch.from_arrays([batch["file"], batch["block"], pa.array(at), batch["line"]], names=["file", "block", "at", "line"])


def read_lines(spark: SparkSession, path: str, exclude: str | None = None) -> DataFrame:
    """(file, pos, line) of the lines that are not blank; pos counts those."""
    split = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = spark.read.text(path).select(*split, F.col("value").alias("line")).where(F.trim("line") != "")
    if exclude:
        lines = lines.where(~file_name(F.col("file")).rlike(exclude))
    lines = lines.mapInArrow(_counted, "file string, block long, at long, line string")
    before = Window.partitionBy("of").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy(F.col("file").alias("of"), F.col("block").alias("start")).agg((F.max("at") + 1).alias("n"))
    splits = splits.select("of", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    joined = lines.join(splits, (F.col("file") == F.col("of")) & (F.col("block") == F.col("start")))
    return joined.select("file", (F.col("before") + F.col("at")).alias("pos"), "line")


def read_dense(spark: SparkSession, path: str, exclude: str | None = None) -> DataFrame:
    """(file, pos, embedding) of lines of numbers separated by commas or white space."""
    tokens = F.filter(F.split("line", r"[,\s]+"), lambda t: t != "")
    return read_lines(spark, path, exclude).select("file", "pos", F.transform(tokens, lambda t: t.cast("float")).alias("embedding"))


def read_sparse(spark: SparkSession, path: str, dimension: int | None, exclude: str | None = None) -> DataFrame:
    """(file, pos, cells) of lines of active cell numbers; a cell outside the dimension raises."""
    if dimension is None:
        raise ValueError("sparse text needs a dimension")
    rows = read_lines(spark, path, exclude).select("file", "pos", parse_cells(F.col("line")).alias("cells"))
    wrong = F.exists("cells", lambda c: (c < 0) | (c >= dimension))
    return rows.withColumn("cells", F.when(wrong, F.raise_error(F.concat(F.lit(f"cell outside dimension {dimension} in "), "file"))).otherwise(F.col("cells")))


def load_vectors(spark: SparkSession, path: str, fmt: str | None = None, dimension: int | None = None, sparse: bool = False, order: str = "name") -> DataFrame:
    """Vectors with vec_id from a file or folder; an unknown suffix is read as text."""
    kind = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in KINDS:
        return numbered(read_vecs(spark, path, kind), order)
    return numbered(read_sparse(spark, path, dimension) if sparse else read_dense(spark, path), order)


def load_folder(spark: SparkSession, path: str, kinds: tuple[str, ...] | None = None, dimension: int | None = None, sparse: bool = False, order: str = "name") -> DataFrame:
    """Vectors with vec_id of a folder, in order over all its files, each read by its suffix; an unknown suffix is read as text.

    kinds leaves only files of the given suffixes.
    """
    if kinds is None:
        names = spark.read.format("binaryFile").load(path).select(F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("kind"))
        kinds = tuple(sorted(r.kind for r in names.distinct().collect()))  # as many rows as there are suffixes
    known = "|".join(KINDS)
    out = None
    for kind in dict.fromkeys(k if k in KINDS else "" for k in kinds):
        if kind:
            rows = read_vecs(spark, path, kind)
        else:
            others = "|".join(k for k in kinds if k not in KINDS)
            skip = rf"(?i)(\.({known})$)|^(?!.*\.({others})$)" if "" not in kinds else rf"(?i)\.({known})$"
            rows = read_sparse(spark, path, dimension, skip) if sparse else read_dense(spark, path, skip)
        if not sparse:
            rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x.cast("float")))
        out = rows if out is None else out.unionByName(rows)
    return numbered(out, order)


def first_rows(vectors: DataFrame, n: int) -> DataFrame:
    """The first n vectors by vec_id."""
    return vectors.where(F.col("vec_id") < n)


def query_files(rows: DataFrame, first: int = FIRST_QUERY) -> DataFrame:
    """rows of files whose first number is `first` or more, with that number as query_offset and qid = offset + pos."""
    number = F.regexp_extract(file_name(F.col("file")), r"(\d+)", 1).try_cast("long")
    return rows.withColumn("query_offset", number).where(F.col("query_offset") >= first).withColumn("qid", F.col("query_offset") + F.col("pos"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(qid, neighbors) of lines qid,n1,n2,...: other tokens are skipped, a later file or line of a qid holds."""
    numbers = F.transform(F.split("line", r"\s*,\s*"), lambda t: F.trim(t).try_cast("long"))
    rows = read_lines(spark, path).select("file", "pos", numbers.alias("x")).where(F.get("x", F.lit(0)).isNotNull())
    rest = F.array_distinct(F.filter(F.slice("x", 2, 1 << 30), lambda v: v.isNotNull()))
    order = F.struct("file", "pos")
    return rows.groupBy(F.get("x", F.lit(0)).alias("qid")).agg(F.max_by(rest, order).alias("neighbors"))


def ground_truth_matrix(vectors: DataFrame) -> DataFrame:
    """(qid, neighbors) of an ivecs matrix with vec_id: row numbers are query ids."""
    return vectors.select(F.col("vec_id").alias("qid"), F.transform("embedding", lambda x: x.cast("long")).alias("neighbors"))


def _write_lines(rows: DataFrame, path: str, line: Column, key: str) -> None:
    """One line per row, in the order of key over the files in the order of their names."""
    rows.orderBy(key).select(line.alias("value")).write.mode("append").text(path)


def write_dense(vectors: DataFrame, path: str, vector: str = "embedding", key: str = "vec_id") -> None:
    """Write vectors as lines of numbers separated by commas; read_dense gives the same floats.

    A null vector or one without entries would be a blank line, which readers skip: it raises.
    """
    text = F.array_join(F.transform(vector, lambda x: x.cast("string")), ",", "NaN")
    blank = F.coalesce(F.size(vector), F.lit(0)) < 1
    _write_lines(vectors, path, F.when(blank, F.raise_error(F.lit("a vector without entries has no line"))).otherwise(text), key)


def write_sparse(vectors: DataFrame, path: str, key: str = "vec_id") -> None:
    """Write rasters (key, cells) as lines of cell numbers; rasters without cells have no line and go."""
    _write_lines(vectors.where(F.size("cells") > 0), path, F.array_join(F.transform(F.array_sort("cells"), lambda x: x.cast("string")), ","), key)


def write_ground_truth(truth: DataFrame, path: str) -> None:
    """Write (qid, neighbors) as lines qid,n1,n2,...; where a qid has several rows any of them may be read back."""
    numbers = F.concat(F.array(F.col("qid").cast("string")), F.transform("neighbors", lambda x: x.cast("string")))
    _write_lines(truth, path, F.array_join(numbers, ","), "qid")
