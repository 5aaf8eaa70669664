"""Vectorised text helpers used inside Arrow batches: words, word hashes, shingles.

Words are runs of bytes other than space and 0x09-0x0D, so UTF-8 never needs
decoding.  A word's hash is a polynomial over random 64-bit byte codes, taken
from running sums over at most a chunk, then mixed; hashes are the same in
every task.  What is held per byte of a text, however long, is a few flags.
"""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
PORTION_BYTES = 4 << 20
PIECE_BYTES = 1 << 15  # a piece's running sums stay in a core's cache
SHINGLE = 5

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
CODES = np.random.default_rng(20240607).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_CODES = CODES[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_MUL = np.uint64(0xBF58476D1CE4E5B9)
_ROLL = np.uint64(0x94D049BB133111EB)

_up = np.cumprod(np.r_[np.uint64(1), np.full(CHUNK_BYTES, _BASE, np.uint64)])
_down = np.cumprod(np.r_[np.uint64(1), np.full(CHUNK_BYTES, _BASE_INV, np.uint64)])

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:
    _LIBC = None
_released = [0.0]


def release(every: float = 2.0) -> None:
    """Give memory that is free back to the system, where the C library can, at most once in so many seconds."""
    if time.monotonic() - _released[0] >= every:
        pa.default_memory_pool().release_unused()
        if hasattr(_LIBC, "malloc_trim"):
            _LIBC.malloc_trim(0)
        _released[0] = time.monotonic()


def tidy(run: Callable) -> Callable:
    """A function of Arrow batches that leaves no free memory with its worker, which the next task may not need."""

    @wraps(run)
    def batches(*args):
        for out in run(*args):
            yield out
            release()
        release(0.0)

    return batches


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed bijection that spreads 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h *= _MUL
    h ^= h >> np.uint64(29)
    h *= _ROLL
    h ^= h >> np.uint64(32)
    return h


def running_sums(data: np.ndarray, codes: np.ndarray = CODES) -> np.ndarray:
    """Sums of codes times powers of the base before each of at most CHUNK_BYTES bytes, and after the last."""
    total = np.zeros(len(data) + 1, np.uint64)
    value = codes[data]
    value *= _up[: len(data)]
    np.cumsum(value, out=total[1:])
    return total


def range_sums(data: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray = CODES) -> np.ndarray:
    """The polynomial hash, not mixed, of each of ascending byte ranges; equal bytes have equal hashes wherever they stand."""
    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE_BYTES, "right")))
        low = int(start[i])
        if end[j - 1] - low <= PIECE_BYTES:
            total = running_sums(data[low : int(end[j - 1])], codes)
            out[i:j] = (total[end[i:j] - low] - total[start[i:j] - low]) * _down[start[i:j] - low]
        else:  # one range longer than a piece
            for at in range(low, int(end[i]), CHUNK_BYTES):
                part = running_sums(data[at : min(at + CHUNK_BYTES, int(end[i]))], codes)[-1:]
                out[i : i + 1] += part * np.array([pow(_BASE, at - low, 2**64)], np.uint64)
        i = j
    return out


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """The hash of the `size` bytes at each place of at most CHUNK_BYTES bytes."""
    total = running_sums(data)
    return mix((total[size:] - total[:-size]) * _down[: max(0, len(data) - size + 1)])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array (null: empty) and the n + 1 offsets into them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `limit` bytes each; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def portions(batches: Iterator[pa.RecordBatch], limit: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each are of about `limit` bytes; a longer text stands alone."""
    for batch in batches:
        _, offsets = text_bytes(batch["text"])
        for i, j in chunks(offsets, limit):
            yield batch.slice(i, j - i)


@dataclass
class Words:
    """Words of a chunk: byte ranges, text number of each, first word of each text (n + 1)."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of a chunk's words and those behind their last."""
    inside = ~_SPACE[data]
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[:-1][offsets[:-1] < n]
    before[edges] = False
    ends = offsets[1:][offsets[1:] > 0] - 1
    after[ends] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    start, end = word_bounds(data, offsets)
    first = np.searchsorted(start, offsets, "left")
    return Words(start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first, mix(range_sums(data, start, end, _LOWER_CODES if lower else CODES)))


def word_counts(texts: pa.Array) -> pa.Array:
    """Words of each text; null has none."""
    data, offsets = text_bytes(texts)
    count = [np.zeros(0, np.int64)]
    for i, j in chunks(offsets):
        own = offsets[i : j + 1] - offsets[i]
        count.append(np.diff(np.searchsorted(word_bounds(data[offsets[i] : offsets[j]], own)[0], own)))
    return pa.array(np.concatenate(count), pa.int64())


def roll(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` successive hashes."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _ROLL + hashes[k : n + k]
    return mix(out)


def set_runs(texts: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first position, shingles, edges): the sets of a chunk's texts one behind the other, that of text k between edges k and k + 1.

    A set is sorted and distinct.  ASCII letters are lower-cased.  Fewer than `size` words make one shingle of
    the whole sequence; a text without words has the empty set.
    """
    data, offsets = text_bytes(texts)
    for i, j in chunks(offsets):
        w = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True)
        rolled = roll(w.hash, size)
        count = np.diff(w.first)
        many = np.where(count >= size, count - size + 1, np.minimum(count, 1))
        edge = np.zeros(j - i + 1, np.int64)
        np.cumsum(many, out=edge[1:])
        flat = np.empty(edge[-1], np.uint64)
        for a, n, low, high in zip(w.first.tolist(), count.tolist(), edge.tolist(), edge[1:].tolist(), strict=False):
            if n >= size:
                own = flat[low:high]
                own[:] = rolled[a : a + n - size + 1]
                own.sort()
            elif n:
                flat[low] = roll(w.hash[a : a + n], n)[0] ^ np.uint64(n)
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        new[edge[:-1][many > 0]] = True
        before = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(new, out=before[1:])
        yield i, flat[new], before[edge]
