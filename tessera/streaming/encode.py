"""Encoding a stream of vectors with a fixed codebook: stateless, so batches and streams give the same codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import PQModel


def encode_stream(vectors: DataFrame, model: PQModel) -> DataFrame:
    """(vec_id, codes) of a streaming (or batch) DataFrame of vec_id and embedding."""
    return vectors.select("vec_id", model.code_column(F.col("embedding")).alias("codes"))
