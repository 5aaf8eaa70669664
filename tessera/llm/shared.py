"""Reading tables and cutting lineage, common to the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Folders below that of the session, one for each scratch() that this thread is inside.
_inside: ContextVar[tuple[str, ...]] = ContextVar("inside", default=())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which executors and driver share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
    return "/".join([root.rstrip("/"), *_inside.get(), uuid.uuid4().hex])


@contextmanager
def sent(spark: SparkSession, value) -> Iterator[Broadcast]:
    """A broadcast that lasts as long as the block; what uses it must be written inside."""
    shared = spark.sparkContext.broadcast(value)
    try:
        yield shared
    finally:
        shared.destroy()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that shared_dir() has named."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that this thread names inside the block go at its end, however it ends; what reads them must be written elsewhere inside."""
    own = _inside.set((*_inside.get(), uuid.uuid4().hex))
    try:
        yield
    finally:
        path = shared_dir(spark).rpartition("/")[0]
        _inside.reset(own)
        remove(spark, path)


def written(df: DataFrame, spark: SparkSession) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there."""
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
