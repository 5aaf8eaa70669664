"""A product-quantization model: fit, encode, search, save and load."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import metric
from ..functions.vectors import subvectors, zorder_cells, zorder_dense
from ..operators import sparse
from ..operators.medoids import dbscan_codebook, kmedoids
from ..operators.quantize import MAX_STEPS, book_bytes, encode, first_centroids, parallel_centroids, spread_centroids, train, train_restarted
from ..operators.search import adc_topk, hamming_topk, lookup_tables, packed_tables


#: Bytes of a codebook up to which code_column makes literals of it.
MOST_LITERAL_BYTES = 4 << 20


@dataclass
class PQModel:
    """Codebooks of `parts` subspaces with up to `ks` centroids each.

    `method` is kmeans (start "first", "k-means||" or "k-means++", of which the best
    of `restarts`), kmedoids (start "first", which is a hash order, or "k-medoids++")
    or dbscan; `by` names the metric of training, and `zorder` permutes square
    grids first. With max_steps None training ends when it has converged.
    """

    dimension: int
    parts: int = 4
    ks: int = 256
    by: str = "l2sq"
    method: str = "kmeans"
    start: str = "first"
    zorder: bool = False
    max_steps: int | None = MAX_STEPS
    seed: int = 42
    eps: float = 0.3
    min_samples: int = 5
    restarts: int = 1
    codebook: DataFrame | None = None
    converged: bool = False

    def _ordered(self, vectors: DataFrame, vector: str = "embedding") -> DataFrame:
        if self.zorder and zorder_cells(self.dimension) is not None:
            vectors = vectors.withColumn(vector, zorder_dense(F.col(vector), self.dimension))
        return vectors

    def _sub(self, vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
        return subvectors(self._ordered(vectors, vector), self.parts, self.dimension, vector, key)

    def fit(self, vectors: DataFrame) -> PQModel:
        metric(self.by)
        sub = self._sub(vectors)
        if self.method == "kmeans":
            if self.start not in ("first", "k-means||", "k-means++"):
                raise ValueError(f"unknown start {self.start!r}")
            if self.restarts > 1:
                if self.start != "k-means++" or self.by != "l2sq":
                    raise ValueError("restarts are for k-means++ starts and the metric l2sq")
                done = train_restarted(sub, self.ks, self.restarts, self.seed, self.max_steps)
            else:
                start = {"first": first_centroids, "k-means||": lambda sub, ks: parallel_centroids(sub, ks, self.seed), "k-means++": lambda sub, ks: spread_centroids(sub, ks, self.seed)}
                done = train(sub, start[self.start](sub, self.ks), self.by, self.max_steps)
            self.codebook, self.converged = done.codebook, done.converged
        elif self.method == "kmedoids":
            self.codebook, _ = kmedoids(sub, self.ks, self.by, max_steps=self.max_steps, seed=self.seed, start="random" if self.start == "first" else self.start)
        elif self.method == "dbscan":
            self.codebook, _ = dbscan_codebook(sub, self.eps, self.min_samples, self.by)
        else:
            raise ValueError(f"unknown method {self.method!r}")
        return self

    def _book(self) -> DataFrame:
        if self.codebook is None:
            raise ValueError("the model is not fitted")
        return self.codebook

    def encode(self, vectors: DataFrame) -> DataFrame:
        """(vec_id, codes)."""
        return encode(self._ordered(vectors), self._book(), self.parts, self.dimension, self.by)

    def code_column(self, vector: Column) -> Column:
        """The codes of a vector as an expression, for streams: the codebook, which must be small, becomes literals."""
        if (size := book_bytes(self._book())) > MOST_LITERAL_BYTES:
            raise ValueError(f"a codebook of {size} bytes is too large for an expression, which may have {MOST_LITERAL_BYTES}")
        rows = self._book().orderBy("m", "k").collect()
        books: dict[int, list] = {}
        for r in rows:
            books.setdefault(r.m, []).append(F.struct(F.array(*[F.lit(float(x)) for x in r.centroid]).alias("centroid"), F.lit(r.k).alias("k")))
        order = zorder_cells(self.dimension) if self.zorder else None
        vector = vector if order is None else F.transform(F.array(*[F.lit(c) for c in order]), lambda c: F.get(vector, c))
        w = self.dimension // self.parts
        to = metric(self.by)

        def code(m: int) -> Column:
            sv = F.transform(F.slice(vector, m * w + 1, w), lambda x: x.cast("double"))
            return F.array_min(F.transform(F.array(*books[m]), lambda c: F.struct(to(sv, c["centroid"]).alias("d"), c["k"].alias("k"))))["k"]

        return F.array(*[code(m) for m in range(self.parts)])

    def tables(self, queries: DataFrame, by: str | None = None) -> DataFrame:
        """(qid, lut) of queries (qid, embedding)."""
        return packed_tables(lookup_tables(self._sub(queries, key="qid"), self._book(), by or self.by))

    def search(self, codes: DataFrame, queries: DataFrame, k: int, mode: str = "adc", by: str | None = None, timed: bool = False) -> DataFrame:
        """(qid, rank, vec_id, dist) of the k nearest codes, by lookup tables or by Hamming distance of codes; `timed`: also the seconds of each query's scan.

        For Hamming the queries are coded by Euclidean distance, whatever the codebook's metric.
        """
        if mode == "adc":
            return adc_topk(codes, self.tables(queries, by), k, timed)
        if mode == "hamming":
            return hamming_topk(codes, encode(self._ordered(queries), self._book(), self.parts, self.dimension, key="qid"), k, timed)
        raise ValueError(f"unknown mode {mode!r}")

    def save(self, path: str) -> None:
        """Codebooks, partitioned by subspace, and one row of parameters."""
        self._book().write.mode("overwrite").partitionBy("m").parquet(f"{path}/codebook")
        fields = {k: v for k, v in self.__dict__.items() if k != "codebook"}
        spark = self._book().sparkSession
        kinds = {"int": "int", "int | None": "int", "float": "double", "str": "string", "bool": "boolean"}
        schema = ", ".join(f"{k} {kinds[str(self.__dataclass_fields__[k].type)]}" for k in fields)
        spark.createDataFrame([tuple(fields.values())], schema).write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PQModel:
        row = spark.read.parquet(f"{path}/model").first().asDict()
        book = spark.read.parquet(f"{path}/codebook").select("m", "k", "centroid")
        return cls(**row, codebook=book)


@dataclass
class SparsePQModel:
    """Codebooks of `parts` subspaces of sparse binary vectors (vec_id, cells), which are never made dense.

    `by` is a metric of sets, whose centroids are medoids, or l2sq, whose centroids are
    means with their cells' shares; training starts from the first `ks` subsets.
    """

    dimension: int
    parts: int = 4
    ks: int = 256
    by: str = "jaccard0"
    max_steps: int = 50
    codebook: DataFrame | None = None
    converged: bool = False

    def fit(self, vectors: DataFrame) -> SparsePQModel:
        self.codebook, self.converged = sparse.train_sets(sparse.subsets(vectors, self.parts, self.dimension), self.ks, self.by, self.max_steps)
        return self

    def _book(self) -> DataFrame:
        if self.codebook is None:
            raise ValueError("the model is not fitted")
        return self.codebook

    def encode(self, vectors: DataFrame) -> DataFrame:
        """(vec_id, codes)."""
        return sparse.encode_sets(vectors, self._book(), self.parts, self.dimension, self.by)

    def tables(self, queries: DataFrame, by: str | None = None) -> DataFrame:
        """(qid, lut) of queries (qid, cells)."""
        return sparse.set_tables(queries, self._book(), self.parts, self.dimension, by or self.by)

    def search(self, codes: DataFrame, queries: DataFrame, k: int, mode: str = "adc", by: str | None = None, timed: bool = False) -> DataFrame:
        """(qid, rank, vec_id, dist) of the k nearest codes, by lookup tables or by Hamming distance of codes; `timed`: also the seconds of each query's scan."""
        if mode == "adc":
            return adc_topk(codes, self.tables(queries, by), k, timed)
        if mode == "hamming":
            return hamming_topk(codes, sparse.encode_sets(queries, self._book(), self.parts, self.dimension, self.by, "qid"), k, timed)
        raise ValueError(f"unknown mode {mode!r}")
