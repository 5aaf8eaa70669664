"""Language identification by the nearest of several centroids per language.

A text's vector counts its n-grams of one to three characters, letters with at
most one word boundary at either end, hashed to `DIMENSION` entries: square roots
of the counts times an inverse document frequency, of length one.  Spherical
k-means makes `CENTROIDS` centroids of each language's training vectors, so that
prose, lists and other kinds of text need not share one.  A text gets the language
of the centroid with the greatest cosine, which is also its score.  Each centroid
keeps a radius, within which nearly all of its own training vectors lie; a text
beyond its centroid's radius is `rejected`: the language stands, as the nearest
there is, but the distance says that it may be none of the known ones.

Training takes at most `SAMPLE` documents, an equal share of each language by hash,
of at most `LANGUAGES` languages, the most frequent ones.  Counts are made in
tasks; only those of the sample reach the driver, at most two numbers per entry.
The model sent to the tasks has LANGUAGES x CENTROIDS x DIMENSION numbers at most.

Nulls and odd rows: a null text, and one without a letter, is `und` with score 0 and
not rejected; so is every text where nothing could be learned.  Rows with null
lang are not learned from.  A null doc_id is not held out.  Equal cosines go to
the smaller language in code-point order.  Texts of any length are counted in
pieces; repeated rows are judged alike; an empty table gives no rows.  Only
doc_id, text and (in training) lang are read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table
from .textkit import portions, tidy

DIMENSION, CENTROIDS = 1 << 13, 4
SAMPLE, LANGUAGES = 4000, 250
STEPS = 12
#: A centroid's radius: this quantile of its members' cosine distances, and so much more; from so many members on.
QUANTILE, MARGIN, MEMBERS = 0.99, 1.25, 50
PORTION = 1 << 20
PIECE = 1 << 18
ROWS = 64
UNKNOWN = "und"
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_entries(text: str) -> Iterator[np.ndarray]:
    """The entries of a text's n-grams, piece by piece: each letter, each pair with a letter, each triple around a letter."""
    is_letter, text = letters(), text.lower() + " "
    for low in range(0, len(text), PIECE):
        # A place before the piece and one behind it, boundaries where the text begins and ends.
        around = text[max(0, low - 1) : low + PIECE + 1]
        codes = np.frombuffer(around.encode("utf-32-le"), np.uint32)
        piece = np.pad(np.where(is_letter[codes], codes, 0).astype(np.uint64), (int(low == 0), int(low + PIECE >= len(text))))
        before, middle, behind = piece[:-2], piece[1:-1], piece[2:]
        for h, real in (
            (middle * _P[1] + _P[2], middle != 0),
            (before * _P[0] + middle * _P[1], (before != 0) | (middle != 0)),
            (before * _P[0] + middle * _P[1] + behind * _P[2], middle != 0),
        ):
            h = h[real]
            yield ((h ^ (h >> np.uint64(29))) * _P[0] >> np.uint64(40)).astype(np.int64) % DIMENSION


def counts(texts: list[str | None]) -> np.ndarray:
    """A row of counts for each text."""
    out = np.zeros((len(texts), DIMENSION), np.float32)
    for row, t in zip(out, texts, strict=True):
        if t:
            for entries in gram_entries(t):
                row += np.bincount(entries, minlength=DIMENSION)
    return out


def has_letter(texts: list[str | None]) -> np.ndarray:
    return np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)


@dataclass
class LanguageModel:
    """Centroids of length one, their languages (ascending) and radii, and inverse document frequencies."""

    idf: np.ndarray = field(default_factory=lambda: np.ones(DIMENSION, np.float32))
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMENSION), np.float32))
    languages: list[str] = field(default_factory=list)
    radii: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(languages, scores, rejected) of texts."""
        usable = has_letter(texts) if self.languages else np.zeros(len(texts), bool)
        names, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        rows = np.flatnonzero(usable)
        for i in range(0, len(rows), ROWS):
            at = rows[i : i + ROWS]
            cosine = np.clip(weighted(counts([texts[k] for k in at]), self.idf) @ self.centroids.T, 0, 1).astype(float)
            best = cosine.argmax(1)
            score[at] = cosine[np.arange(len(at)), best]
            rejected[at] = 1 - score[at] > self.radii[best]
            for k, b in zip(at.tolist(), best.tolist(), strict=True):
                names[k] = self.languages[b]
        return names, score, rejected


def weighted(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length one (zeros stay zeros)."""
    out = np.sqrt(rows) * idf
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-12)


def spherical_kmeans(x: np.ndarray, k: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, labels) of rows of length one; the starts are drawn by squared cosine distance from those before."""
    rng = np.random.default_rng(len(x))
    starts = [int((x @ x.mean(0)).argmax())]
    far = np.maximum(1 - x @ x[starts[0]], 0).astype(float)
    while len(starts) < min(k, len(x)) and far.max() > 1e-6:
        starts.append(int(rng.choice(len(x), p=far**2 / (far**2).sum())))
        far = np.minimum(far, np.maximum(1 - x @ x[starts[-1]], 0))
    c, label = x[starts].copy(), None
    for _ in range(steps):
        now = (x @ c.T).argmax(1)
        if label is not None and (now == label).all():
            break
        label = now
        for j in range(len(c)):
            if (label == j).any():
                mean = x[label == j].mean(0)
                c[j] = mean / max(np.sqrt((mean * mean).sum()), 1e-12)
    return c, (x @ c.T).argmax(1)


def fit(rows: np.ndarray, languages: list[str], k: int = CENTROIDS) -> LanguageModel:
    """The model of rows of counts and their languages."""
    if not len(rows):
        return LanguageModel()
    idf = (np.log((1 + len(rows)) / (1 + (rows > 0).sum(0))) + 1).astype(np.float32)
    x, names = weighted(rows, idf), np.array(languages, object)
    model = LanguageModel(idf, languages=[], radii=np.zeros(0))
    found, radii = [], []
    for name in sorted(set(languages)):
        mine = x[names == name]
        c, label = spherical_kmeans(mine, k)
        far = 1 - (mine * c[label]).sum(1)
        for j in range(len(c)):
            members = label == j
            if members.any():
                found.append(c[j])
                # A centroid of few members knows little of how far its texts lie: it takes the language's radius.
                radii.append(MARGIN * float(np.quantile(far[members] if members.sum() >= MEMBERS else far, QUANTILE)))
                model.languages.append(name)
    model.centroids, model.radii = np.array(found, np.float32), np.array(radii)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@tidy
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, mark, entry, times) of rows (lang, mark, text) with a letter."""
    for batch in portions(batches, PORTION):
        texts = batch["text"].to_pylist()
        at = np.flatnonzero(has_letter(texts))
        for i in range(0, len(at), ROWS):
            some = at[i : i + ROWS]
            rows = counts([texts[k] for k in some])
            nonzero = [np.flatnonzero(r) for r in rows]
            lists = [pa.array([e.tolist() for e in nonzero], pa.list_(pa.int32())), pa.array([r[e].tolist() for r, e in zip(rows, nonzero, strict=True)], pa.list_(pa.float32()))]
            chosen = pa.array(some)
            yield pa.RecordBatch.from_arrays([batch["lang"].take(chosen), batch["mark"].take(chosen), *lists], names=["lang", "mark", "entry", "times"])


def train(docs: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> LanguageModel:
    """The model fitted to at most `sample` documents with a lang, and as many of each language as of any other where there are."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("mark"))
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    share = max(1, sample // max(1, sizes.count()))
    # Twice as many as needed are expected of a large language; of the rest all rows are looked at. At most LANGUAGES rows are broadcast.
    part = F.pmod("mark", F.lit(1 << 30)) < F.least(F.lit(1.0), F.lit(2.0 * share + 50) / F.col("n")) * (1 << 30)
    drawn = usable.join(F.broadcast(sizes), "lang").where(part).select("lang", "mark", "text")
    rows = drawn.mapInArrow(_counted, "lang string, mark long, entry array<int>, times array<float>").dropDuplicates(["lang", "mark"])
    order = Window.partitionBy("lang").orderBy("mark")
    found = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= share).orderBy("lang", "mark").select("lang", "entry", "times").toArrow()
    dense = np.zeros((found.num_rows, DIMENSION), np.float32)
    for row, entry, times in zip(dense, found["entry"], found["times"], strict=True):
        row[entry.values.to_numpy()] = times.values.to_numpy()
    return fit(dense, found["lang"].to_pylist(), k)


def identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of each document, from its text alone."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, PORTION):
            names, score, rejected = model.predict(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identified(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
