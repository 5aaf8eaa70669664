"""Quality classifier: a generalised additive model with pairwise interactions.

Text measures are cut into bins at training quantiles.  Boosting goes round the
measures in a cycle; each step fits one tree of depth 2 on one measure to the
loss gradient and adds it, shrunk, to that measure's lookup table.  Then the
pairs whose tables would lower the loss most get 2-d tables, boosted in a cycle
by quadrant trees.  A score is the sigmoid of a sum of table entries.

Training reads at most `SAMPLE` labelled documents, chosen by a hash of
doc_id, outside the held-out third (crc32 of doc_id as text, mod 3 = 1).  Only
that bounded sample's measures reach the driver; scoring is a map over all
documents.  Labels, lang, source and doc_id are no inputs of a score.

Nulls and odd rows: a null or empty text has all measures 0 and is scored like
any other; a null doc_id is not held out and has no label; a document with
conflicting labels counts as the smaller; without any usable label every score
is 0.5.  Repeated rows are scored alike; an empty table gives no rows.  `scored`
replaces an input column named score; `accepted` keeps it as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .repetition import line_repeats, per_text
from .shared import table
from .textkit import Words, chunks, portions, text_bytes, tidy, words

SAMPLE = 20_000
BINS = 48
PAIR_BINS = 8
ROUNDS = 120
PAIR_ROUNDS = 40
PAIRS = 6
RATE = 0.15
RIDGE = 1.0
FEATURES = (
    "log_words", "word_length", "long_words", "capitals", "all_caps", "digits", "symbols", "bangs", "bars", "commas", "stops",
    "non_ascii", "distinct_words", "echoed_words", "line_words", "repeated_lines", "odd_endings",
)


def _among(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int8)
    out[list(chars)] = 1
    return out


_UPPER, _LETTER = _among(bytes(range(65, 91))), _among(bytes(range(65, 91)) + bytes(range(97, 123)))
_DIGIT, _SYMBOL, _BANG, _BAR, _COMMA, _STOP = (_among(c) for c in (b"0123456789", b"#*$%&<>@^~{}[]=_+\\/", b"!?", b"|", b",;:", b"."))
_HIGH = _among(bytes(range(0xC0, 256)))
_END_OK = _LETTER | _DIGIT | _COMMA | _STOP | _among(bytes(range(0x80, 256)) + b"'\")-")
_IS_UPPER = _UPPER.astype(bool)
_CLASSES = np.stack([_LETTER, _UPPER, _DIGIT, _SYMBOL, _BANG, _BAR, _COMMA, _STOP, _HIGH, _among(b"\n")], 1).astype(float)


def distinct_words(w: Words) -> np.ndarray:
    """Distinct words of each text, by as many bits of their hashes as the text's number leaves."""
    n = len(w.first) - 1
    bits = np.uint64(n.bit_length())
    key = np.sort((w.text.astype(np.uint64) << (np.uint64(64) - bits)) | (w.hash >> bits))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> (np.uint64(64) - bits)).astype(np.int64), minlength=n)


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text of a chunk."""
    w = words(data, offsets)
    count = np.diff(w.first).astype(float)
    some = np.maximum(count, 1)
    size = w.end - w.start
    # Bytes of each class in each text, from the text's histogram of bytes.
    of_class = np.array([np.bincount(data[a:b], minlength=256) for a, b in pairwise(offsets.tolist())], float) @ _CLASSES
    letter, upper, *rates, high, breaks = of_class.T
    letters = np.maximum(letter, 1)
    chars = np.maximum(np.diff(offsets), 1)
    of = lambda flags: per_text(flags, w.first) / some
    capitals = np.bincount(np.searchsorted(w.start, np.flatnonzero(_IS_UPPER[data]), "right") - 1, minlength=len(w.start))
    echo = np.zeros(len(w.hash), bool)
    echo[1:] = (w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])
    lines = breaks + 1
    columns = [
        np.log1p(count), per_text(size, w.first) / some, of(size > 12), upper / letters, of((capitals > 1) & (2 * capitals > size)),
        *(r / some for r in rates), high / chars,
        distinct_words(w) / some, of(echo), count / lines, line_repeats(data, offsets, w) / lines,
        of(_END_OK[data[w.end - 1]] == 0),
    ]
    out = np.stack(columns, 1)
    out[count == 0] = 0
    return out


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables; `pairs` holds (measure, measure, table over coarse bins)."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), int)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, total = self.bins(x), np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            total += t[b[:, k]]
        for i, j, t in self.pairs:
            total += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-m))


def _best_cut(g: np.ndarray, h: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
    """(gain, position) of the best cut of bins lo..hi."""
    cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
    if len(cg) < 2:
        return 0.0, -1
    left, right = cg[:-1] ** 2 / (ch[:-1] + RIDGE), (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + RIDGE)
    gain = left + right - cg[-1] ** 2 / (ch[-1] + RIDGE)
    at = int(np.argmax(gain))
    return float(gain[at]), lo + at + 1


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Newton steps per bin of a depth-2 tree over one measure's bins."""
    cuts = [0, len(g)]
    for _ in range(2):
        nodes = list(zip(cuts[:-1], cuts[1:], strict=True))
        cuts = sorted({*cuts, *(at for lo, hi in nodes for gain, at in [_best_cut(g, h, lo, hi)] if gain > 1e-9)})
    out = np.zeros(len(g))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + RIDGE)
    return out


def quadrant_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, Newton steps) of the tree that cuts both measures once."""
    def four(x):
        c = np.cumsum(np.cumsum(x, 0), 1)
        a = c[:-1, :-1]
        b, d = c[:-1, -1:] - a, c[-1:, :-1] - a
        return a, b, d, c[-1, -1] - a - b - d

    sums = list(zip(four(g), four(h), strict=True))
    gain = sum(p**2 / (q + RIDGE) for p, q in sums)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    values = [p[i, j] / (q[i, j] + RIDGE) for p, q in sums]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Boosted lookup tables for labels y (0 or 1) of the rows of x."""
    if not len(y):
        return AdditiveModel()
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = AdditiveModel(base=float(np.log(rate / (1 - rate))))
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    model.edges = [np.unique(np.quantile(x[:, k], quantiles)) for k in range(x.shape[1])]
    b = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(n) for n in sizes]
    margin = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for k, n in enumerate(sizes):
            p = _sigmoid(margin)
            step = RATE * shallow_tree(np.bincount(b[:, k], y - p, n), np.bincount(b[:, k], p * (1 - p), n))
            model.tables[k] += step
            margin += step[b[:, k]]
    model.coarse = [np.arange(n) * PAIR_BINS // n for n in sizes]
    wide = np.stack([model.coarse[k][b[:, k]] for k in range(len(sizes))], 1)
    cells = PAIR_BINS * PAIR_BINS

    def tree(i: int, j: int) -> tuple[float, np.ndarray, np.ndarray]:
        p, at = _sigmoid(margin), wide[:, i] * PAIR_BINS + wide[:, j]
        gain, out = quadrant_tree(np.bincount(at, y - p, cells).reshape(PAIR_BINS, -1), np.bincount(at, p * (1 - p), cells).reshape(PAIR_BINS, -1))
        return gain, out, at

    ranked = sorted(((tree(i, j)[0], i, j) for i in range(len(sizes)) for j in range(i)), reverse=True)[:PAIRS]
    model.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in ranked]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model.pairs:
            _, out, at = tree(i, j)
            t += RATE * out
            margin += RATE * out.ravel()[at]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@tidy
def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        data, offsets = text_bytes(batch["text"])
        for i, j in chunks(offsets):
            rows = measures(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i).cast(pa.int64()), pa.array(list(rows), pa.list_(pa.float64()))], names=["doc_id", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AdditiveModel:
    """The model fitted to at most `sample` labelled documents that are not held out."""
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    chosen = usable.groupBy(F.col("doc_id").alias("labelled")).agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("labelled"), "labelled").limit(sample)
    # At most `sample` rows of two numbers are broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"), "left_semi")
    rows = texts.mapInArrow(_measured, "doc_id long, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x"))
    found = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select("doc_id", "x", "quality").toArrow()
    if not found.num_rows:
        return AdditiveModel()
    found = found.sort_by("doc_id")
    return fit(np.array(found["x"].to_pylist()), found["quality"].to_numpy().astype(float))


def _scores(model: AdditiveModel, batch: pa.RecordBatch) -> np.ndarray:
    data, offsets = text_bytes(batch["text"])
    return np.concatenate([np.zeros(0), *(model.score(measures(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in chunks(offsets))])


def scored(docs: DataFrame, model: AdditiveModel, columns: list[str] | None = None) -> DataFrame:
    """The named columns of docs (all, unless given) behind the column score."""
    names = [c for c in columns or docs.columns if c != "score"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_scores(model, batch)), *[batch[c] for c in names]], names=["score", *names])

    kept = docs.select(*dict.fromkeys([*names, "text"]))
    return kept.mapInArrow(run, StructType([StructField("score", DoubleType()), *[kept.schema[c] for c in names]]))


def accepted(docs: DataFrame, model: AdditiveModel, least: float = 0.5) -> DataFrame:
    """The rows of docs that score `least` or more, with their own columns."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            yield batch.filter(pa.array(_scores(model, batch) >= least))

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored_digest(docs, train(docs, table(spark, sf_dir, "labels")))


def scored_digest(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    rows = scored(docs, model, ["doc_id"])
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
