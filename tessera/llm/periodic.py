"""Periodic runs of words inside documents, by probing a harmonic grid.

A run is a stretch of words with smallest period q, of at least max(6, 4 q) words,
that no neighbour extends.  Its words equal those q further on for at least 3 q
places, so three successive multiples of q lie among those places wherever the
run begins.  For each p the word hashes at multiples of p are compared with those
one p further: n / p probes, and n log n over all p.  Where three in a row
agree, four more places between them are probed; what survives is extended to
both sides by comparing slices that double in size.

Grid points inside a found run whose period divides p are skipped: a stretch of
period p that has p words in common with that run lies in it and has the smaller
period.  So every stretch that is extended has p as its smallest period.

The texts of a portion are probed as one array, longest first, with a word of its
own behind each text; for a period p only the texts of 4 p words or more, the
array's beginning, are looked at.

Nulls and odd rows: a null text has no words and no runs, like an empty one;
with a null doc_id the text stays as it is; repeated rows are judged alike; a
document of any length stays whole within its task, and its collapsed text is
hashed piece by piece; an empty table gives no rows.  Only doc_id and text are
read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import table
from .textkit import mix, portions, text_bytes, tidy, words

LEAST, TIMES = 6, 4
SLICE, MOST_SLICE = 32, 1 << 16
#: Bytes of collapsed text that are put together at once.
PIECE_BYTES = 4 << 20
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

Run = tuple[int, int, int]  # start, length, period


def to_the_right(w: np.ndarray, at: int, p: int) -> int:
    """The first place from `at` on whose word differs from that p further, or has none there."""
    stop, size = len(w) - p, SLICE
    while at < stop:
        differs = w[at : min(at + size, stop)] != w[at + p : min(at + size, stop) + p]
        if differs.any():
            return at + int(differs.argmax())
        at, size = min(at + size, stop), min(2 * size, MOST_SLICE)
    return at


def to_the_left(w: np.ndarray, at: int, p: int) -> int:
    """The first place of the stretch before `at` whose words equal those p further."""
    size = SLICE
    while at > 0:
        low = max(0, at - size)
        differs = (w[low:at] != w[low + p : at + p])[::-1]
        if differs.any():
            return at - int(differs.argmax())
        at, size = low, min(2 * size, MOST_SLICE)
    return at


def runs_of(w: np.ndarray, lengths: np.ndarray) -> list[Run]:
    """The runs of an array of word hashes that holds texts of descending lengths, a word of its own behind each."""
    found: dict[int, tuple[list[int], list[int]]] = {}
    out: list[Run] = []
    ends = np.cumsum(lengths + 1)
    for p in range(1, int(lengths[0]) // TIMES + 1 if len(lengths) else 0):
        texts = int(np.searchsorted(-lengths, -max(LEAST, TIMES * p), "right"))
        if not texts:
            continue
        part = w[: ends[texts - 1]]
        grid = part[::p]
        equal = grid[1:] == grid[:-1]
        at = np.flatnonzero(equal[:-2] & equal[1:-1] & equal[2:]) * p
        for probe in (p // 2, p + p // 2, p // 3, p + p // 3) if p > 1 and len(at) else ():
            at = at[part[at + probe] == part[at + probe + p]]
        for q, (starts, stops) in found.items() if len(at) else ():
            if p % q == 0:
                last = np.searchsorted(starts, at, "right") - 1
                at = at[(last < 0) | (np.asarray(stops)[last] <= at + p)]
        done = 0
        for i in at.tolist():
            if i < done:
                continue
            low, done = to_the_left(part, i, p), to_the_right(part, i, p)
            length = done - low + p
            if length >= max(LEAST, TIMES * p):
                out.append((low, length, p))
                starts, stops = found.setdefault(p, ([], []))
                starts.append(low)
                stops.append(low + length)
    return out


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """Which original word stands at each place of a document: every tenth, by hash of its id, repeats words."""
    source = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        source[a:] = a + (source[a:] - a) % p
    return source


def joined_digest(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> str:
    """SHA-256 of the words data[start:end] joined by one space."""
    digest = hashlib.sha256()
    sizes = end - start + 1
    total = np.cumsum(sizes)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(total, total[i] - sizes[i] + PIECE_BYTES, "right")))
        before = total[i:j] - sizes[i:j] - (total[i] - sizes[i])
        at = np.arange(int(total[j - 1] - total[i] + sizes[i])) + np.repeat(start[i:j] - before, sizes[i:j])
        piece = data[np.minimum(at, len(data) - 1)]
        piece[before + sizes[i:j] - 1] = 32
        digest.update(piece[: len(piece) - (j == len(start))])
        i = j
    return digest.hexdigest()


def described(doc_id: int | None, n: int, runs: list[Run], data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple:
    """A row of RESULT from a document's runs and its words' byte ranges."""
    runs = sorted((s, p, m) for s, m, p in runs)
    edges = np.zeros(n + 1, np.int64)
    for s, p, m in runs:
        edges[s + p] += 1
        edges[s + m] -= 1
    kept = np.cumsum(edges[:-1]) == 0 if runs else slice(None)
    best = max(runs, key=lambda r: (Fraction(r[2], r[1]), -r[0], -r[1]), default=None)
    longest = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    listed = "".join(f"{s},{m},{p}\n" for s, p, m in runs)
    return doc_id, len(runs), *longest, hashlib.sha256(listed.encode()).hexdigest(), joined_digest(data, start[kept], end[kept])


def judged(ids: list[int | None], data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
    """Rows of RESULT for the texts of a portion."""
    found = words(data, offsets)
    counts = np.diff(found.first)
    sources = [found.first[k] + planted(i, int(counts[k])) for k, i in enumerate(ids)]
    order = np.argsort(-counts, kind="stable")
    stops = mix(np.arange(len(ids), dtype=np.uint64) + np.uint64(1 << 62))
    w = np.concatenate([np.zeros(0, np.uint64), *(x for k in order for x in (found.hash[sources[k]], stops[k : k + 1]))])
    first = np.cumsum(counts[order] + 1) - counts[order] - 1
    runs: list[list[Run]] = [[] for _ in ids]
    for low, length, p in runs_of(w, counts[order]):
        k = int(np.searchsorted(first, low, "right")) - 1
        runs[order[k]].append((low - int(first[k]), length, p))
    return [described(i, int(counts[k]), runs[k], data, found.start[sources[k]], found.end[sources[k]]) for k, i in enumerate(ids)]


@tidy
def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    names = [c.split()[0] for c in RESULT.split(", ")]
    for batch in portions(batches):
        rows = judged(batch["doc_id"].cast(pa.int64()).to_pylist(), *text_bytes(batch["text"]))
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per document, see RESULT: no shuffle, each document judged where it is read."""
    return docs.select("doc_id", "text").mapInArrow(_judged, RESULT)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"))
