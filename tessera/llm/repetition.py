"""Quality rules on repetition inside a document, from suffix arrays.

Inside an Arrow batch the suffixes of many documents are sorted together but
never tie across documents, words in the order of their hashes.  Prefix doubling
ranks all windows of `WINDOW` words: suffixes whose first window is unique in
their document are resolved by it, the tied ones are sorted by (rank, rank h
words on) with h doubling.  Longest common prefixes of neighbours come from the ranks kept per
doubling.  Their intervals with differing left words are the maximal repeated
substrings; a suffix is covered as far as its longest common prefix with a
neighbour, and the union of those spans is that of all the intervals' spans.

A document is kept if the base rules hold, the union of its maximal repeats'
spans covers at most `COVERED` of its words, below what the base rules allow,
and its longest repeat has at most `LONGEST` words or `LONGEST_SHARE` of the
document's, whichever is more: a passage said twice in a long text weighs less.

Nulls and odd rows: a null text has no words (and fails); repeated rows are
judged alike; a document of any length stays whole within its task; an empty
table gives no rows.  Only doc_id and text are read, so clashing names do no
harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import table
from .textkit import Words, chunks, mix, portions, range_sums, roll, text_bytes, tidy, words

WINDOW = 8
MIN_WORDS = 20
BASE_PERCENT = 30
COVERED = 0.25
LONGEST = 50
LONGEST_SHARE = 0.02
SYMBOLS = b"#*$%&|<>"

_IS_SYMBOL = np.zeros(256, np.int8)
_IS_SYMBOL[list(SYMBOLS)] = 1
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, longest_repeat long, n_maximal_repeats long"


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags between successive offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def window_ranks(w: Words, size: int) -> np.ndarray:
    """Of each word, the rank of the `size` words from it on (fewer at a text's end) in its text, in the order of word hashes; texts in turn."""
    n = len(w.hash)
    end = np.repeat(w.first[1:], np.diff(w.first))
    rank = np.unique(w.text * np.int64(n + 2) + np.unique(w.hash, return_inverse=True)[1], return_inverse=True)[1]
    at, span = np.arange(n), 1
    while span < size:
        step = min(span, size - span)
        on = at + step
        rank = np.unique(rank * np.int64(n + 2) + np.where(on < end, rank[np.minimum(on, n - 1)] + 1, 0), return_inverse=True)[1]
        span += step
    return rank


def tied_suffixes(w: Words, size: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Sorted suffixes whose first `size` words recur in their text, ranks per doubling, last window starts."""
    n = len(w.hash)
    end = np.repeat(w.first[1:], np.diff(w.first))
    last = end - size  # of each word's text: where the last window starts
    if n < size:
        return np.zeros(0, np.int64), [], last
    rank = window_ranks(w, size)
    order = np.argsort(rank, kind="stable")
    key = rank[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    tied = ~new
    tied[:-1] |= ~new[1:]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    suffixes, place = order[tied], np.flatnonzero(tied)
    ranks, active, h = [], np.arange(len(suffixes)), size
    while len(active):
        ranks.append(rank.copy())
        p = suffixes[active]
        on = p + h
        follow = np.where(on < end[p], rank[np.minimum(on, n - 1)], -1)
        group = rank[p]
        by = np.lexsort((follow, group))
        p, follow, group = p[by], follow[by], group[by]
        suffixes[active] = p
        new = np.ones(len(p), bool)
        new[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        rank[p] = place[np.maximum.accumulate(np.where(new, active, 0))]
        tied = ~new
        tied[:-1] |= ~new[1:]
        active = active[tied]
        h *= 2
    return suffixes, ranks, last


def common_prefixes(w: Words, suffixes: np.ndarray, ranks: list[np.ndarray], last: np.ndarray, size: int) -> np.ndarray:
    """Words that each sorted suffix shares with the one before (0: less than a window, or another text)."""
    if not len(suffixes):
        return np.zeros(0, np.int64)
    end = w.first[1:][w.text[suffixes]]
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    same = ranks[0][a] == ranks[0][b]
    stop_a, stop_b = end[:-1], end[1:]
    for level in range(len(ranks) - 1, -1, -1):
        ok = same & (a <= stop_a - size) & (b <= stop_b - size)
        ok[ok] = ranks[level][a[ok]] == ranks[level][b[ok]]
        a[ok] += size << level
        b[ok] += size << level
    more = same.copy()
    for _ in range(size - 1):
        more &= (a < stop_a) & (b < stop_b)
        more[more] = w.hash[a[more]] == w.hash[b[more]]
        a[more] += 1
        b[more] += 1
    out = np.zeros(len(suffixes), np.int64)
    out[1:] = np.where(same, a - suffixes[:-1], 0)
    return out


def maximal_repeats(w: Words, suffixes: np.ndarray, shared: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, words, occurrences) of each interval of common prefixes that can't be extended to the left."""
    if not len(suffixes):
        return []
    opens = suffixes == w.first[w.text[suffixes]]
    left = np.where(opens, suffixes.astype(np.uint64), w.hash[suffixes - 1])
    differs = np.zeros(len(suffixes), np.int64)
    differs[1:] = (left[1:] != left[:-1]) | opens[1:] | opens[:-1]
    differs = np.cumsum(differs).tolist()
    texts, found, stack = w.text[suffixes].tolist(), [], []
    for i, v in enumerate([*shared.tolist(), 0]):
        start = i - 1
        while stack and stack[-1][1] > v:
            start, length = stack.pop()
            if differs[i - 1] > differs[start]:
                found.append((texts[start], length, i - start))
        if v and (not stack or stack[-1][1] < v):
            stack.append((start, v))
    return found


def line_repeats(data: np.ndarray, offsets: np.ndarray, w: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text, per text."""
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    text = np.searchsorted(offsets[1:], start, "right")
    # A line break at a text's very end opens an empty line there, which counts to the next text; it has no word.
    end = np.append(start[1:], len(data))
    full = np.searchsorted(w.start, end, "left") > np.searchsorted(w.start, start, "left")
    start, end, text = start[full], end[full], text[full]
    if not len(start):
        return np.zeros(len(offsets) - 1, np.int64)
    end = end - (data[end - 1] == 10)
    key = mix(range_sums(data, start, end) + mix((end - start).astype(np.uint64)))
    key = mix(key + mix(text.astype(np.uint64) + np.uint64(7)))
    _, first = np.unique(key, return_index=True)
    return np.bincount(text, minlength=len(offsets) - 1) - np.bincount(text[first], minlength=len(offsets) - 1)


def judge(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> dict[str, np.ndarray]:
    """The result columns, but doc_id, for the texts of one chunk."""
    n = len(offsets) - 1
    w = words(data, offsets)
    count = np.diff(w.first)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[w.start] += 1
    inside[w.end] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    suffixes, ranks, last = tied_suffixes(w, window)
    shared = common_prefixes(w, suffixes, ranks, last, window)
    reach = np.maximum(shared, np.append(shared[1:], 0)) if len(shared) else shared
    edges = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(edges, suffixes, 1)
    np.add.at(edges, suffixes + reach, -1)
    covered = per_text(np.cumsum(edges[:-1]) > 0, w.first)
    longest, repeats = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.maximum.at(longest, w.text[suffixes], shared)
    for text, _, _ in maximal_repeats(w, suffixes, shared):
        repeats[text] += 1
    failed = (count < MIN_WORDS) | (100 * covered > BASE_PERCENT * count)
    held = (covered <= COVERED * count) & (longest <= np.maximum(LONGEST, LONGEST_SHARE * count))
    return {
        "n_words": count, "word_chars": per_text(inside & ((data & 0xC0) != 0x80), offsets), "n_symbols": per_text(_IS_SYMBOL[data], offsets),
        "n_dup_lines": line_repeats(data, offsets, w), "n_repeat_words": covered, "base_failed": failed, "kept": ~failed & held,
        "longest_repeat": longest, "n_maximal_repeats": repeats,
    }


@tidy
def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        data, offsets = text_bytes(batch["text"])
        for i, j in chunks(offsets):
            found = judge(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            kinds = {"base_failed": pa.bool_(), "kept": pa.bool_()}
            arrays = [pa.array(v, kinds.get(k, pa.int64())) for k, v in found.items()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i).cast(pa.int64()), *arrays], names=["doc_id", *found])


def repetition_rules(docs: DataFrame) -> DataFrame:
    """One row per document, see RESULT: no shuffle, each document judged where it is read."""
    return docs.select("doc_id", "text").mapInArrow(_judged, RESULT)


def op2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents"))
