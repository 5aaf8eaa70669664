"""Benchmark decontamination by SimHash over item-sized windows.

For a benchmark item of n words the windows are the n successive words at every
position of a document (the whole document if it is shorter).  Words have ASCII
letters lower-cased.  Each window's 64-bit SimHash over word counts is looked
up in a multi-index of BLOCKS blocks of 16 bits.  Fingerprints within RADIUS
bits differ in at most FLIPS bits of some block, and items stand in the index
under all values of each block that are so near, so one exact look-up a block
finds all items within the radius.  These candidates are verified by the exact
weighted five-word-shingle similarity, sum of minima over sum of maxima of the
shingle counts, which must reach SIMILARITY.

A window that holds too few places with a shingle of an item of its size cannot
reach the similarity, so only windows with enough of them are fingerprinted;
this screen loses nothing and leaves most documents untouched.  Places near one
another share their windows, so that long items cost what their windows do.  Texts under five words make one
shingle of the whole sequence, so shorter items are found where a document has
exactly their words in a row.

The benchmark is read in blocks of at most BLOCK_ITEMS items and BLOCK_CHARS
characters on average, each broadcast in turn and then dropped; documents are
never shuffled.  Sums of a long text are made a span of words at a time.

Nulls and odd rows: items and documents without words match nothing; repeated
items and documents are matched each; null ids are kept as null; empty tables
give no rows.  Only the text and id columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import sent, table, written
from .textkit import SHINGLE, Words, chunks, portions, roll, text_bytes, tidy, words

SIMILARITY = 0.75
RADIUS = 15
BLOCKS = 4
FLIPS = RADIUS // BLOCKS
BLOCK_ITEMS = 2_000
SPAN = 1 << 14
BLOCK_CHARS = 32 << 20
FOUND = "doc_id long, item_id long, start_word long, n_words long, hamming int, similarity double"

_BLOCK_BITS = 64 // BLOCKS
_TABLE_BITS = 20


def shingles_of(hashes: np.ndarray) -> np.ndarray:
    if len(hashes) >= SHINGLE:
        return roll(hashes, SHINGLE)
    return roll(hashes, len(hashes)) ^ np.uint64(len(hashes)) if len(hashes) else hashes


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two shingle lists, by their counts."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    shared = sum((x & y).values())
    return shared / (len(a) + len(b) - shared) if len(a) + len(b) else 0.0


def sliding_similarities(text: np.ndarray, start: np.ndarray, stop: np.ndarray, item: np.ndarray) -> list[float]:
    """The similarity to an item's shingles of windows start..stop of a text's shingles, by ascending starts: shingles that come and go are counted, so a window costs its step from the one before."""
    kinds, want = np.unique(item, return_counts=True)
    low, high = int(start[0]), int(stop.max())
    at = np.minimum(np.searchsorted(kinds, text[low:high]), len(kinds) - 1)
    of, want = np.where(kinds[at] == text[low:high], at, -1).tolist(), want.tolist()
    have, shared, a, b, out = [0] * len(want), 0, low, low, []
    for s, e in zip(start.tolist(), stop.tolist(), strict=True):
        if s >= b:
            have, shared, a, b = [0] * len(want), 0, s, s
        for k in of[b - low : e - low]:
            if k >= 0:
                have[k] += 1
                shared += have[k] <= want[k]
        b = max(b, e)
        for k in of[a - low : s - low]:
            if k >= 0:
                shared -= have[k] <= want[k]
                have[k] -= 1
        a = s
        out.append(shared / (b - s + len(item) - shared))
    return out


def signs(hashes: np.ndarray) -> np.ndarray:
    """A row of 64 values +1 or -1 per word."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def window_prints(hashes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The fingerprints of windows of words, sorted by start, from running sums over about SPAN words at a time."""
    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        low = int(start[i])
        over = np.flatnonzero(stop[i:] > low + SPAN)
        j = i + (int(over[0]) if len(over) else len(start) - i)
        if j == i:  # one window longer than a span
            total = sum(signs(hashes[at : min(at + SPAN, int(stop[i]))]).sum(0, dtype=np.int64) for at in range(low, int(stop[i]), SPAN))
            out[i], j = fingerprints(total[None])[0], i + 1
        else:
            high = int(stop[i:j].max())
            total = np.zeros((high - low + 1, 64), np.int32)
            np.cumsum(signs(hashes[low:high]), axis=0, dtype=np.int32, out=total[1:])
            out[i:j] = fingerprints(total[stop[i:j] - low] - total[start[i:j] - low])
        i = j
    return out


@cache
def near_values() -> np.ndarray:
    """Differences of at most FLIPS bits between two values of a block."""
    return np.array([sum(1 << b for b in bits) for n in range(FLIPS + 1) for bits in combinations(range(_BLOCK_BITS), n)], np.int64)


def block_keys(prints: np.ndarray, number: np.ndarray) -> np.ndarray:
    """(print, block) keys made of a number (that of the window's size), block and value."""
    shifts = np.arange(BLOCKS, dtype=np.uint64) * np.uint64(_BLOCK_BITS)
    values = ((prints[:, None] >> shifts) & np.uint64((1 << _BLOCK_BITS) - 1)).astype(np.int64)
    return ((number[:, None] * BLOCKS + np.arange(BLOCKS)) << _BLOCK_BITS) | values


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges lo..hi: the range number and value of each member."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]


@dataclass
class Index:
    """Items, the places of their shingles and the multi-index of their fingerprints."""

    ids: list
    sizes: np.ndarray
    distinct: np.ndarray  # sizes, ascending
    shingles: list[np.ndarray]
    prints: np.ndarray
    anchor: np.ndarray
    anchor_item: np.ndarray
    table: np.ndarray
    keys: np.ndarray
    key_item: np.ndarray


def build_index(ids: list, texts: list) -> Index:
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    w = words(data, offsets, lower=True)
    own = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    keep = [k for k, h in enumerate(own) if len(h)]
    own = [own[k] for k in keep]
    shingles = [shingles_of(h) for h in own]
    sizes = np.array([len(h) for h in own], np.int64)
    zero = np.zeros(1, np.int64)
    prints = np.concatenate([window_prints(h, zero, zero + len(h)) for h in own]) if own else np.zeros(0, np.uint64)
    pairs = np.unique(np.array([(int(s), k) for k, ss in enumerate(shingles) for s in ss.tolist()], dtype=[("s", "<u8"), ("k", "<i8")]))
    filled = np.zeros(1 << _TABLE_BITS, bool)
    filled[(pairs["s"] >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
    distinct = np.unique(sizes)
    near = near_values()
    keys = (block_keys(prints, np.searchsorted(distinct, sizes))[:, :, None] ^ near).astype(np.uint32).ravel()
    order = np.argsort(keys, kind="stable")
    return Index([ids[k] for k in keep], sizes, distinct, shingles, prints, pairs["s"], pairs["k"], filled, keys[order], (order // (BLOCKS * len(near))).astype(np.int32))


def anchored_windows(index: Index, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (start, item size), sorted, of the windows that hold enough shingles of items of that size to reach SIMILARITY."""
    places, values = [], []
    for n in [*(k for k in range(1, SHINGLE) if k in index.distinct), SHINGLE]:
        run = roll(w.hash, n) if n == SHINGLE else roll(w.hash, n) ^ np.uint64(n)
        at = np.flatnonzero((w.text[: len(run)] == w.text[n - 1 :]) & index.table[(run >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)]) if len(run) else np.zeros(0, np.int64)
        places.append(at)
        values.append(run[at])
    at, value = np.concatenate(places), np.concatenate(values)
    if not len(at):
        return at, at
    hit, place = spread(np.searchsorted(index.anchor, value, "left"), np.searchsorted(index.anchor, value, "right"))
    kind = np.searchsorted(index.distinct, index.sizes[index.anchor_item[place]])
    # Each place once per size; keys put the sizes' places one behind the other.
    far = np.int64(len(w.hash) + 1)
    key = np.unique(kind * far + at[hit])
    kind, at = key // far, key % far
    if not len(at):
        return at, at
    size = index.distinct[kind]
    first, end = w.first[:-1][w.text[at]], w.first[1:][w.text[at]]
    lo = np.maximum(first, at + np.minimum(SHINGLE, size) - size)
    hi = np.maximum(np.minimum(at, end - size), first)
    # Ranges that overlap are one: starts are looked at once per size.
    order = np.lexsort((lo, kind))
    lo, hi, kind = lo[order], hi[order], kind[order]
    reach = np.maximum.accumulate(kind * far + hi)
    new = np.ones(len(lo), bool)
    new[1:] = kind[1:] * far + lo[1:] > reach[:-1]
    opens = np.flatnonzero(new)
    which, start = spread(lo[opens], reach[np.append(opens[1:], len(lo)) - 1] % far + 1)
    kind = kind[opens][which]
    size = index.distinct[kind]
    # Shared shingles are no more than the window's places with a shingle of an item of that size; a similarity needs so many.
    stop = np.minimum(start + size, w.first[1:][w.text[start]])
    span = np.minimum(SHINGLE, size)
    count = np.searchsorted(key, kind * far + np.maximum(stop - span + 1, start)) - np.searchsorted(key, kind * far + start)
    mine, other = np.maximum(stop - start - span + 1, 1), np.maximum(size - span + 1, 1)
    enough = count >= SIMILARITY / (1 + SIMILARITY) * (mine + other) - 1e-9
    start, size = start[enough], size[enough]
    order = np.lexsort((size, start))
    return start[order], size[order]


def matches(index: Index, w: Words) -> list[tuple[int, int, int, int, int, float]]:
    """(text, item, start word in it, words, Hamming distance, similarity) of the best window per text and item."""
    if not len(index.ids):
        return []
    start, size = anchored_windows(index, w)
    best: dict[tuple[int, int], tuple] = {}
    text = w.text[start] if len(start) else start
    for t in np.unique(text):
        own = text == t
        s, n = start[own], size[own]
        first, end = int(w.first[t]), int(w.first[t + 1])
        stop = np.minimum(s + n, end)
        prints = window_prints(w.hash, s, stop)
        keys = block_keys(prints, np.searchsorted(index.distinct, n)).astype(np.uint32).ravel()
        lookup, place = spread(np.searchsorted(index.keys, keys, "left"), np.searchsorted(index.keys, keys, "right"))
        pairs = np.unique(np.stack([lookup // BLOCKS, index.key_item[place]], 1), axis=0)
        apart = np.bitwise_count(prints[pairs[:, 0]] ^ index.prints[pairs[:, 1]])
        pairs, apart = pairs[apart <= RADIUS], apart[apart <= RADIUS]
        # By item, then by start; windows of five words or more are measured one after the other.
        order = np.lexsort((s[pairs[:, 0]], pairs[:, 1]))
        pairs, apart = pairs[order], apart[order]
        rolled = roll(w.hash[first:end], SHINGLE)
        for group in np.split(np.arange(len(pairs)), np.flatnonzero(np.diff(pairs[:, 1])) + 1) if len(pairs) else ():
            item, at = int(pairs[group[0], 1]), pairs[group, 0]
            if end - first >= SHINGLE and index.sizes[item] >= SHINGLE:
                same = sliding_similarities(rolled, s[at] - first, stop[at] - first - SHINGLE + 1, index.shingles[item])
            else:
                same = [similarity(shingles_of(w.hash[s[k] : stop[k]]), index.shingles[item]) for k in at]
            top = max(range(len(same)), key=lambda k: (same[k], -k))
            if same[top] >= SIMILARITY:
                k = at[top]
                best[int(t), item] = (-same[top], s[k], int(s[k]) - first, int(stop[k] - s[k]), int(apart[group[top]]))
    return [(t, item, b[2], b[3], b[4], -b[0]) for (t, item), b in sorted(best.items())]


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """An index of each of the benchmark's blocks."""
    items = benchmark.select("item_id", "text").where("text is not null")
    rows, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-rows // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        yield build_index(part["item_id"].to_pylist(), part["text"].to_pylist())


def _found(shared):
    """For each chunk of texts its number in the batch, the batch and the matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        index = shared.value
        for batch in portions(batches):
            data, offsets = text_bytes(batch["text"])
            found = []
            for i, j in chunks(offsets):
                w = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True)
                found += [(i + t, *rest) for t, *rest in matches(index, w)]
            yield batch, found

    return run


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """FOUND rows: per document and benchmark item that it holds, the best window (ties: the first)."""

    def search(shared):
        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, found in _found(shared)(batches):
                ids = batch["doc_id"].cast(pa.int64()).to_pylist() if found else []
                rows = [(ids[t], shared.value.ids[item], *rest) for t, item, *rest in found]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
                columns = zip(*rows, strict=True) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in FOUND.split(", ")])

        return docs.select("doc_id", "text").mapInArrow(run, FOUND)

    out = None
    for index in indexes(benchmark):
        with sent(spark, index) as shared:
            one = written(search(shared), spark)
        out = one if out is None else out.unionByName(one)
    return out


def clean_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item, all columns kept; a map over the documents per block, written if more follow."""

    def cleaned(docs: DataFrame, shared) -> DataFrame:
        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, found in _found(shared)(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[m[0] for m in found]] = False
                yield batch.filter(pa.array(keep))

        return docs.mapInArrow(run, docs.schema)

    every = indexes(benchmark)
    index = next(every)
    for following in every:
        with sent(spark, index) as shared:
            docs = written(cleaned(docs, shared), spark)
        index = following
    return cleaned(docs, spark.sparkContext.broadcast(index))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
