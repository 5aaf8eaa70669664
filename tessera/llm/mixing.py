"""Mixing sources to target weights.

Word counts are summed per source (partial sums before the shuffle), each
source gets a target, and every document is emitted floor(rate) times plus one
hash-seeded Bernoulli copy with the rate's fraction as probability.  Words are
counted over Arrow batches, of the text alone.

Targets share `share` times all words by weight.  A target stops at `most`
times its source's words and the excess is shared out again by weight until
none is above: with sources ordered by cap / weight this is one pass of running
sums, because the capped sources are a prefix of that order.

Nulls and odd rows: a null text has size 0; the null source is a source of its
own, ordered last; a null doc_id draws by its text.  Repeated rows are mixed
like any other row.  An empty table gives no rows.  Sources are meant to be few:
the pass over them is one task's work, of one row a source.  Only the operator's own
output columns are added, and the input's columns of those names are replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .shared import table, written
from .textkit import word_counts

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 17
MOST_SENT = 100_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size): one row per source.

    The windows run over one row per source, after the aggregation.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything, order = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(most)).alias("cap"))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(share)
    left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0))
    level = (total - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / left
    per = per.withColumn("level", level)
    open_level = F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(everything)
    target = F.when(open_level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), open_level * F.col("w")))
    return per.select("source", "source_size", target.alias("target"))


@F.arrow_udf(LongType())
def _n_words(text: pa.Array) -> pa.Array:
    return word_counts(text)


def mixing_plan(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target, rate and copies (how often the mix takes the row)."""
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "rate", "copies")]
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    draw = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))
    # Sizes and draws are taken before the join, so that a query without the text doesn't shuffle it.
    sized = docs.select(*own).withColumns({"size": _n_words(F.col("text")), "__draw": draw})
    targets = source_targets(sized.select("source", "size")).withColumnRenamed("source", "__source")
    # One row per source; while there are few, they are sent, so that no text is shuffled.
    targets = written(targets, docs.sparkSession)
    targets = F.broadcast(targets) if targets.count() <= MOST_SENT else targets
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor("rate") + F.when(F.col("__draw") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return joined.withColumn("rate", rate).withColumn("copies", copies.cast("long")).drop("__draw")


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixed corpus: each row of docs once per copy, with copy numbers from 0."""
    return mixing_plan(docs, seed).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


def digest(docs: DataFrame) -> DataFrame:
    plan = mixing_plan(docs.select("doc_id", "source", "text"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP6_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, text FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w,
         CAST(source_size AS DOUBLE) * 2.0::DOUBLE AS cap FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER e, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER e, 0)) AS level
  FROM weighed WINDOW e AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, coalesce(least(cap, w * (SELECT max(level) FROM levels WHERE level * w <= cap)), cap) AS target FROM levels),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS draw
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM rated
"""
