"""fvecs, ivecs and bvecs files: per row a little-endian int32 dimension, then that many values.

Spark's binaryFile source lists the files; where pyarrow knows their file system,
tasks then read whole records of byte ranges of RANGE_BYTES, so that files may
be of any size, and elsewhere a file is one task's work.  Rows keep their file
and position, from which `numbered` makes vec_id.

"vecs" is a data source over pyarrow's file systems, to be registered with
`register`.  Read, it gives (vec_id, embedding) of a folder's files in the order of
their names, in partitions of whole records; comparisons of vec_id with constants
are pushed down, so that partitions without such rows are not made and the others
read their own records only.  Written, each task writes a file.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

#: Suffix, NumPy type of a value, Arrow and Spark types of an entry.
KINDS = {"fvecs": ("<f4", pa.float32(), "float"), "ivecs": ("<i4", pa.int32(), "int"), "bvecs": ("u1", pa.int16(), "smallint")}
ROWS = 4096
RANGE_BYTES = 32 << 20
#: Schemes of file systems that pyarrow reads by itself.
OPENED = ("file", "s3", "gs", "hdfs", "abfs", "abfss")


def decoded(data: bytes, kind: str, step: int | None = None) -> np.ndarray:
    """The rows of a file, or of a part of one with records of `step` bytes; the first record's dimension holds for all."""
    value = np.dtype(KINDS[kind][0])
    step = _step(data[:4], len(data), kind) if step is None else step
    d = (step - 4) // value.itemsize
    rows = np.frombuffer(data, np.uint8).reshape(-1, step)
    if (np.ascontiguousarray(rows[:, :4]).view("<i4") != d).any():
        raise OSError("rows of different dimensions")
    return np.ascontiguousarray(rows[:, 4:]).view(value)


def encoded(rows: np.ndarray, kind: str) -> bytes:
    value = np.dtype(KINDS[kind][0])
    head = np.full((len(rows), 1), rows.shape[1], "<i4").view(np.uint8)
    return np.hstack([head, np.ascontiguousarray(rows.astype(value)).view(np.uint8).reshape(len(rows), -1)]).tobytes()


def _step(head: bytes, size: int, kind: str) -> int:
    """Bytes of a record, from the file's first four bytes and its size."""
    if size < 4:
        raise OSError("empty vector file")
    d = int(np.frombuffer(head, "<i4", 1)[0])
    step = 4 + d * np.dtype(KINDS[kind][0]).itemsize
    if d <= 0 or size % step:
        raise OSError(f"{size} bytes are no whole rows of dimension {d}")
    return step


def _batches(name: str, rows: np.ndarray, first: int, kind: str) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), ROWS):
        part = rows[k : k + ROWS]
        offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
        values = pa.ListArray.from_arrays(offsets, pa.array(part.ravel()).cast(KINDS[kind][1]))
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(first + k, first + k + len(part))), values], names=["file", "pos", "embedding"])


def _ranges(kind: str):
    """The records that start in the byte ranges (path, length, low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, low, high in zip(*(batch[c].to_pylist() for c in ("path", "length", "low", "high")), strict=True):
                # Spark writes local paths as file:/x, pyarrow as file:///x.
                store, where = _opened(name)
                with store.open_input_file(where) as source:
                    step = _step(source.read(4) if size >= 4 else b"", size, kind)
                    first, last = -(-low // step), -(-min(high, size) // step)
                    if first < last:
                        source.seek(first * step)
                        yield from _batches(name, decoded(source.read((last - first) * step), kind, step), first, kind)

    return run


def _whole(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                yield from _batches(name.as_py(), decoded(data.as_py(), kind), 0, kind)

    return run


def read_vecs(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(file, pos, embedding) of the file, or of all files of the kind in the folder, at path."""
    kind = kind or path.rsplit(".", 1)[-1]
    if kind not in KINDS:
        raise ValueError(f"unknown vector format {kind!r}; known: {', '.join(KINDS)}")
    schema = f"file string, pos long, embedding array<{KINDS[kind][2]}>"
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(path)
    listed = files.select("path", "length")
    schemes = {r[0] for r in listed.select(F.substring_index("path", ":", 1)).distinct().limit(20).collect()}
    if not schemes:  # Spark lists no empty files
        raise OSError(f"no vectors at {path}: missing or empty vector file")
    if not schemes <= set(OPENED):
        return files.select("path", "content").mapInArrow(_whole(kind), schema)
    low = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(RANGE_BYTES).cast("long")))
    ranges = listed.select("path", "length", low.alias("low")).withColumn("high", F.col("low") + RANGE_BYTES)
    return ranges.repartition("path", "low").mapInArrow(_ranges(kind), schema)


def numbered(rows: DataFrame, order: str = "name") -> DataFrame:
    """rows (file, pos, ...) with vec_id: files in order, positions counted on from file to file.

    `name` orders by file name; `number` by the first digits after an underscore (0 without), then name.
    """
    number = F.coalesce(F.regexp_extract(F.element_at(F.split("file", "/"), -1), r"_(\d+)", 1).try_cast("long"), F.lit(0))
    keys = [F.col("file")] if order == "name" else [number, F.col("file")]
    # One row per file: the window runs over files, not rows.
    files = rows.groupBy("file").agg((F.max("pos") + 1).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return rows.join(files, "file").withColumn("vec_id", F.col("offset") + F.col("pos")).drop("offset")


@dataclass
class _Written(WriterCommitMessage):
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.kind, self.field = options["path"], options.get("kind", "fvecs"), options.get("vector", schema.names[0])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, folder = _opened(self.path)
        store.create_dir(folder, recursive=True)
        name, rows = f"{folder}/part-{context.partitionId():05d}.{self.kind}", 0
        # A retried task overwrites its own file; the move makes whole files only appear.
        with store.open_output_stream(f"{name}.{context.attemptNumber()}.tmp") as out:
            for batch in iterator:
                if batch.num_rows:
                    values = np.stack([np.asarray(v) for v in batch[self.field].to_pylist()])
                    out.write(encoded(values, self.kind))
                    rows += batch.num_rows
        if rows:
            store.move(f"{name}.{context.attemptNumber()}.tmp", name)
        else:
            store.delete_file(f"{name}.{context.attemptNumber()}.tmp")
        return _Written(rows)

    def commit(self, messages: list[_Written]) -> None:
        pass


def _opened(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow.fs import FileSystem

    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    return FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class _Range(InputPartition):
    """Records low..high of a file whose first record has vec_id `first`."""

    path: str
    step: int
    first: int
    low: int
    high: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "fvecs")
        if self.kind not in KINDS:
            raise ValueError(f"unknown vector format {self.kind!r}; known: {', '.join(KINDS)}")
        self.bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.low, self.high = 0, 1 << 62  # of vec_id
        self.among: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("vec_id",) or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual)):
                yield f
            elif isinstance(f, In):
                values = {v for v in f.value if v is not None}
                self.among = values if self.among is None else self.among & values
            else:
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value + (not isinstance(f, LessThan)))

    def partitions(self) -> list[_Range]:
        from pyarrow.fs import FileSelector, FileType

        store, where = _opened(self.path)
        info = store.get_file_info(where)
        files = [info] if info.type == FileType.File else store.get_file_info(FileSelector(where, allow_not_found=False))
        files = sorted((f for f in files if f.type == FileType.File and f.path.endswith(f".{self.kind}")), key=lambda f: f.path)
        if not files:
            raise OSError(f"no vectors at {self.path}: missing or empty vector file")
        out, first = [], 0
        low, high = self.low, self.high
        if self.among is not None:
            low, high = max([low, min(self.among, default=1 << 62)]), min([high, max(self.among, default=-1) + 1])
        for f in files:
            with store.open_input_file(f.path) as source:
                step = _step(source.read(4) if f.size >= 4 else b"", f.size, self.kind)
            n, each = f.size // step, max(1, self.bytes // step)
            begin, end = max(0, low - first), min(n, high - first)
            out += [_Range(f.path, step, first, k, min(k + each, end)) for k in range(begin, end, each) if self.among is None or any(first + k <= v < first + min(k + each, end) for v in self.among)]
            first += n
        return out or [_Range("", 1, 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition.low >= partition.high:
            return
        store, _ = _opened(self.path)
        with store.open_input_file(partition.path) as source:
            source.seek(partition.low * partition.step)
            for k in range(partition.low, partition.high, ROWS):
                n = min(ROWS, partition.high - k)
                rows = decoded(source.read(n * partition.step), self.kind, partition.step)
                ids = np.arange(partition.first + k, partition.first + k + n)
                if self.among is not None:
                    rows, ids = rows[some := np.isin(ids, list(self.among))], ids[some]
                offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()).cast(KINDS[self.kind][1]))], names=["vec_id", "embedding"])


class VecsSource(DataSource):
    """`spark.read.format("vecs").option("kind", "fvecs").load(path)`; `df.write.format("vecs").option("kind", "fvecs")`, one file per task."""

    @classmethod
    def name(cls) -> str:
        return "vecs"

    def schema(self) -> str:
        return f"vec_id bigint, embedding array<{KINDS[self.options.get('kind', 'fvecs')][2]}>"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make "vecs" known to the session, and let it take filters, which Spark only gives to Python sources where that is allowed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VecsSource)


def write_vecs(vectors: DataFrame, path: str, kind: str = "fvecs", vector: str = "embedding") -> None:
    """Write a vector column; rows keep the order of (vec_id) if there is one."""
    if kind not in KINDS:
        raise ValueError(f"unknown vector format {kind!r}; known: {', '.join(KINDS)}")
    if "vec_id" in vectors.columns:
        vectors = vectors.orderBy("vec_id")
    vectors.sparkSession.dataSource.register(VecsSource)
    vectors.select(vector).write.format("vecs").mode("append").option("kind", kind).option("vector", vector).save(path)
