"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if a string of `SIZE` bytes around it also starts in a document of
smaller doc_id.  The suffixes of all documents are dealt to buckets by the
smallest `GRAM`-byte hash (leftmost on ties) among their first SIZE bytes, the
anchor.  Equal SIZE-byte strings have equal anchors at equal distance, so a
bucket decides alone.  Successive suffixes of one anchor travel as one segment.

Inside a bucket the positions whose distance to the anchor lies in a difference
cover modulo `PERIOD` are ranked first, by doubling from PERIOD bytes.  Then
the suffixes are sorted one block at a time, a block holding those of one
distance to the anchor: by their first PERIOD bytes, long ties by the rank of a
cover position within them, which all suffixes of a block have at the same
place.  Neighbours that share SIZE bytes are compared by doc_id.  Only one
block's keys exist at a time beside the cover ranks.

Before that, anchors that only one document has are screened out by a bitmap
that is built in slices from all documents' anchors.  It has about a bit for
each anchor, up to 2^MOST_SCREEN_BITS; in larger corpora it only lets more pass.
Equal segments stand once in a packet and in a bucket's text, with all their
holders.  Segments of hot anchors, those of `HOT` segments or more in all, are
cut into their single suffixes, which are dealt by anchor, distance and content,
so that no bucket has to hold all that surrounds a frequent passage.  That takes
ten times the bytes, so HOT is what a bucket can hold beside its own share: it
does not depend on the size of the corpus, or on how many packets that makes.

Nulls and odd rows: a null text is empty and loses nothing; texts under SIZE
bytes lose nothing; a null doc_id counts as larger than all others; rows of
equal doc_id never remove from each other, and equal rows get equal results;
an empty table gives no rows.  Long texts are read piece by piece.  Only doc_id
and text are read.  Needs the package zstandard.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .textkit import CHUNK_BYTES, chunks, gram_hashes, mix, portions, range_sums, release, text_bytes, tidy

SIZE = 50
GRAM = 24
PERIOD = 16
MOST_SCREEN_BITS = 29
ANCHOR_BYTES = 14  # of text for each anchor, about
PACKET_BYTES = 16 << 20  # of text that one set of packets is made of
BUCKET_BYTES = 4 << 20
HOT = 1 << 15  # segments of an anchor, about 2 MB
MANY = 8  # segments in a portion from which they are counted one by one
MOST_HOT = 1 << 18
LAST = np.int64(2**63 - 1)

HEAD = np.dtype([("key", "<u8"), ("doc", "<i8"), ("hash", "<i8"), ("start", "<u4"), ("off", "u1"), ("len", "u1")])
SPANS = "doc long, hash long, start long, stop long"


def difference_cover(period: int) -> tuple[int, ...]:
    """The first smallest set whose differences take every value modulo period."""
    for size in range(1, period + 1):
        for d in combinations(range(period), size):
            if len({(a - b) % period for a in d for b in d}) == period:
                return d
    raise ValueError(period)


COVER = difference_cover(PERIOD)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, text, first suffix, last suffix, anchor position) of each run of suffixes with one anchor."""
    n = len(data) - GRAM + 1
    if n < SIZE - GRAM + 1:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)
    # The hash's top 58 bits, then the distance to the gram: minima keep the leftmost of equal grams.
    best = gram_hashes(data, GRAM) & ~np.uint64(63)
    width, span = SIZE - GRAM + 1, 1
    while span < width:
        step = min(span, width - span)
        best = np.minimum(best[:-step], best[step:] + np.uint64(step))
        span += step
    stop = np.maximum(offsets[1:] - SIZE + 1, offsets[:-1])
    counts = stop - offsets[:-1]
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[:-1][text]
    if not len(at):
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)
    anchor = at + (best[at] & np.uint64(63)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return best[at[first]] >> np.uint64(6), text[first], at[first], at[last], anchor[first]


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, first text, place of the bytes in it): the texts in pieces, a long one in several that overlap by a suffix."""
    most = CHUNK_BYTES - SIZE
    for i, j in chunks(offsets, most):
        low, high = int(offsets[i]), int(offsets[j])
        if high - low <= most:
            yield data[low:high], offsets[i : j + 1] - low, i, 0
        else:
            for at in range(low, high, most):
                stop = min(at + most + SIZE - 1, high)
                yield data[at:stop], np.array([0, stop - at]), i, at - low


def _deal(rows: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(block, kind="stable")
    block = block[order]
    edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else np.zeros(1, int)
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        yield int(block[i]), rows[order[i:j]]


def _anchor_keys(bits: int):
    """Each document's distinct anchors as 32-bit keys by bucket, none more than twice from a portion; and of those that more than MANY of its documents have, the number of the others."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, PACKET_BYTES):
            keys, texts = [], []
            for part, offsets, i, _ in pieces(*text_bytes(batch["text"])):
                key, text, *_ = segments(part, offsets)
                keys.append(key)
                texts.append((i + text).astype(np.int32))
            if not keys:
                continue
            key, text = np.concatenate(keys), np.concatenate(texts)
            order = np.lexsort((text, key))
            key, text = key[order], text[order]
            again = np.zeros(len(key), bool)
            again[1:] = (key[1:] == key[:-1]) & (text[1:] == text[:-1])
            key = key[~again]
            edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, int)
            count = np.diff(edges)
            third = np.zeros(len(key), bool)
            third[2:] = key[2:] == key[:-2]
            often = np.flatnonzero(count > MANY)
            more = {b: r.tobytes() for b, r in _deal(np.stack([key[edges[often]] >> np.uint64(26 - bits) & np.uint64(0xFFFFFFFF), count[often] - 2], 1).astype(np.uint32), (key[edges[often]] >> np.uint64(58 - bits)).astype(np.int64))}
            key = key[~third]
            rows = list(_deal((key >> np.uint64(26 - bits)).astype(np.uint32), (key >> np.uint64(58 - bits)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([r.tobytes() for _, r in rows], pa.binary()), pa.array([more.get(b, b"") for b, _ in rows], pa.binary())], names=["bucket", "data", "more"])

    return run


def _screen_slice(bits: int, screen_bits: int, hot: int):
    """(bucket, flags, hot): a slice of the bitmap, and the bucket's keys of `hot` segments or more, those of most if they are too many."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        value = np.sort(np.concatenate([np.frombuffer(d.as_py(), np.uint32) for d in rows["data"]]))
        shared = value[1:][value[1:] == value[:-1]]
        flags = np.zeros(1 << (screen_bits - bits), np.uint8)
        flags[shared >> np.uint32(32 - screen_bits + bits)] = 1
        many, count = np.unique(shared, return_counts=True)
        more = np.concatenate([np.frombuffer(d.as_py(), np.uint32) for d in rows["more"]]).reshape(-1, 2)
        np.add.at(count, np.searchsorted(many, more[:, 0]), more[:, 1])
        at = np.flatnonzero(count + 1 >= hot)
        at = at[np.argsort(-count[at], kind="stable")][: max(1, MOST_HOT >> bits)]
        return pa.table({"bucket": [key[0].as_py()], "flags": pa.array([np.packbits(flags).tobytes()], pa.binary()), "hot": pa.array([many[at].tobytes()], pa.binary())})

    return run


def screen(docs: DataFrame, bits: int, screen_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap of the anchors that two documents share, of 2^screen_bits bits, and the sorted keys, cut to 32 + bits bits, of hot anchors."""
    dealt = docs.select("text").mapInArrow(_anchor_keys(bits), "bucket long, data binary, more binary")
    slices = dealt.groupBy("bucket").applyInArrow(_screen_slice(bits, screen_bits, HOT), "bucket long, flags binary, hot binary").toArrow()
    whole = np.zeros(1 << (screen_bits - 3), np.uint8)
    part, hot = len(whole) >> bits, [np.zeros(0, np.uint64)]
    for b, flags, keys in zip(slices["bucket"].to_pylist(), slices["flags"].to_pylist(), slices["hot"].to_pylist(), strict=True):
        whole[b * part : (b + 1) * part] = np.frombuffer(flags, np.uint8)
        hot.append((np.uint64(b) << np.uint64(32)) | np.frombuffer(keys, np.uint32).astype(np.uint64))
    return whole, np.sort(np.concatenate(hot))


def _gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of many ranges, one after the other."""
    where = np.repeat(start - (np.cumsum(length) - length), length)
    where += np.arange(len(where))
    return data[where]


def _content(body: np.ndarray, length: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A hash of each segment's bytes, length and anchor."""
    stop = np.cumsum(length)
    return mix(range_sums(body, stop - length, stop) + mix(length.astype(np.uint64) + mix(key)))


def _first_holders(head: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(same, later): a number per distinct segment, and whether a smaller doc_id has an equal one."""
    _, same = np.unique(_content(body, head["len"].astype(np.int64), head["key"]), return_inverse=True)
    least = np.full(same.max() + 1 if len(same) else 0, LAST)
    np.minimum.at(least, same, head["doc"])
    return same, head["doc"] > least[same]


def _by_byte(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on: equal high bytes stand together."""
    return values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def head_bytes(head: np.ndarray) -> bytes:
    """A packet's heads by field, without keys, which the bodies' anchors give again."""
    return _by_byte(np.diff(head["doc"], prepend=np.int64(0))) + _by_byte(head["start"])[: 4 * len(head)] + head["hash"].tobytes() + head["off"].tobytes() + head["len"].tobytes()


def head_of(raw: bytes) -> np.ndarray:
    """The heads of a packet, with keys still 0."""
    n = len(raw) // 22
    head = np.zeros(n, HEAD)
    doc, start = np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n), np.frombuffer(raw, np.uint8, 4 * n, 8 * n).reshape(4, n)
    head["doc"] = np.cumsum(np.ascontiguousarray(doc.T).view("<i8").ravel())
    head["start"] = np.ascontiguousarray(start.T).view("<u4").ravel()
    head["hash"] = np.frombuffer(raw, "<i8", n, 12 * n)
    head["off"], head["len"] = np.frombuffer(raw, np.uint8, 2 * n, 20 * n).reshape(2, n)
    return head


def anchor_keys(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The keys of the grams that start at the given ascending places."""
    grams = _gather(body, at, np.full(len(at), GRAM))
    edge = np.arange(len(at)) * GRAM
    return mix(range_sums(grams, edge, edge + GRAM)) >> np.uint64(6)


def _spans(doc: np.ndarray, of: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[pa.Array]:
    return [pa.array(doc, pa.int64()), pa.array(of, pa.int64()), pa.array(start, pa.int64()), pa.array(stop, pa.int64())]


def suffixes_apart(head: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments cut into one of SIZE bytes for each of their suffixes."""
    length = head["len"].astype(np.int64)
    count = length - SIZE + 1
    which = np.repeat(np.arange(len(head)), count)
    step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    out = head[which]
    out["start"] += step.astype(np.uint32)
    out["off"] -= step.astype(np.uint8)
    out["len"] = SIZE
    begin = np.cumsum(length) - length
    return out, _gather(body, begin[which] + step, np.full(len(which), SIZE))


def _sent_segments(shared, bits: int, screen_bits: int):
    """Segments that pass the screen, packed by bucket; and, bucket under 0, spans that equal segments of the portion decide."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hot = shared.value
        press = zstandard.ZstdCompressor(level=6)
        for batch in portions(batches, PACKET_BYTES):
            doc = batch["doc_id"].cast(pa.int64()).fill_null(int(LAST)).to_numpy()
            of = batch["hash"].to_numpy()
            heads, bodies = [], []
            for part, offsets, i, place in pieces(*text_bytes(batch["text"])):
                key, text, first, last, anchor = segments(part, offsets)
                bit = key >> np.uint64(58 - screen_bits)
                keep = (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (7 - (bit & np.uint64(7)).astype(np.uint8))) & 1 == 1
                key, text, first, last, anchor = (x[keep] for x in (key, text, first, last, anchor))
                head = np.empty(len(key), HEAD)
                head["key"], head["doc"], head["hash"] = key, doc[i + text], of[i + text]
                head["start"], head["off"], head["len"] = first - offsets[text] + place, anchor - first, last - first + SIZE
                body = _gather(part, first, last - first + SIZE)
                cut = np.isin(key >> np.uint64(26 - bits), hot)
                if cut.any():
                    where = np.repeat(cut, head["len"].astype(np.int64))
                    small, its = suffixes_apart(head[cut], body[where])
                    heads += [head[~cut], small]
                    bodies += [body[~where], its]
                else:
                    heads.append(head)
                    bodies.append(body)
            if not heads:
                continue
            head, body = np.concatenate(heads), np.concatenate(bodies)
            heads = bodies = None
            _, later = _first_holders(head, body)
            gone = head[later]
            length = head["len"].astype(np.int64)
            begin = np.cumsum(length) - length
            left = np.flatnonzero(~later)
            deal = mix(head["key"][left])
            apart = np.isin(head["key"][left] >> np.uint64(26 - bits), hot)
            if apart.any():
                some = left[apart]
                deal[apart] = mix(_content(_gather(body, begin[some], length[some]), length[some], head["key"][some] + head["off"][some]))
            order = np.lexsort((head["doc"][left], deal >> np.uint64(64 - bits)))
            packed = list(_deal(left[order], (deal[order] >> np.uint64(64 - bits)).astype(np.int64)))
            blobs = [(press.compress(head_bytes(head[at])), press.compress(_gather(body, begin[at], length[at]).tobytes())) for _, at in packed]
            if len(gone):
                spans = np.stack([gone["doc"], gone["hash"].astype(np.int64), gone["start"].astype(np.int64), gone["start"].astype(np.int64) + gone["len"]], 1)
                # Decided spans need no bucket: they are dealt by the hash of their first text.
                packed.append((int(-1 - (abs(int(gone["hash"][0])) % (1 << bits))), None))
                blobs.append((press.compress(spans.T.tobytes()), b""))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in packed], pa.int64()), *[pa.array([x[k] for x in blobs], pa.binary()) for k in (0, 1)]], names=["bucket", "head", "body"])

    return run


def _words_at(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one big-endian number."""
    eight = np.lib.stride_tricks.sliding_window_view(body, 8)[at]
    return np.ascontiguousarray(eight).view(">u8").ravel().astype(np.uint64)


def cover_ranks(body: np.ndarray, end: np.ndarray, phase: np.ndarray, longest: int) -> np.ndarray:
    """Rank of the suffix (up to `end`) at each cover position, equal suffixes sharing one; -1 elsewhere.

    body is padded by PERIOD bytes; phase is the distance to the anchor modulo PERIOD.
    """
    sample = np.flatnonzero(_IN_COVER[phase])
    left = np.minimum(end[sample] - sample, PERIOD)
    a, b = _words_at(body, sample), _words_at(body, sample + 8)
    for word, n in ((a, left), (b, left - 8)):  # bytes past the end count as zero
        cut = np.clip(8 - n, 0, 8).astype(np.uint64) * np.uint64(8)
        word[:] = np.where(cut >= 64, np.uint64(0), (word >> np.minimum(cut, np.uint64(63))) << np.minimum(cut, np.uint64(63)))
    ranks = np.full(len(body), -1, np.int64)

    def rank(*keys: np.ndarray) -> None:
        order = np.lexsort(keys)
        new = np.zeros(len(order), bool)
        for k in keys:
            new[1:] |= k[order[1:]] != k[order[:-1]]
        ranks[sample[order]] = np.cumsum(new)

    rank(left, b, a)
    h = PERIOD
    while h < longest:
        on = sample + h
        follow = np.where(on < end[sample], ranks[np.minimum(on, len(ranks) - 1)], -1)
        rank(follow, ranks[sample])
        h *= 2
    return ranks


def repeated_suffixes(body: np.ndarray, length: np.ndarray, off: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Flags, by place in body, of the suffixes whose SIZE bytes a segment of smaller doc_id has too.

    The segments of a bucket stand one after the other in body; off is the
    place of a segment's anchor in it.
    """
    begin = np.cumsum(length) - length
    flags = np.zeros(len(body), bool)
    if not len(length):
        return flags
    padded = np.concatenate([body, np.zeros(2 * PERIOD, np.uint8)])
    owner = np.repeat(np.arange(len(length)), length)
    end = np.append((begin + length)[owner], np.zeros(2 * PERIOD, np.int64))
    phase = (np.arange(len(body)) - (begin + off)[owner]) % PERIOD
    ranks = cover_ranks(padded, end, phase, int(length.max()))
    for distance in range(SIZE - GRAM + 1):
        own = np.flatnonzero((off >= distance) & (off - distance <= length - SIZE))
        if len(own) < 2:
            continue
        at = begin[own] + off[own] - distance
        ahead = next(d for d in range(PERIOD) if _IN_COVER[(d - distance) % PERIOD])
        one, two = _words_at(padded, at), _words_at(padded, at + 8)
        order = np.lexsort((ranks[at + ahead], two, one))
        at, own, one, two = at[order], own[order], one[order], two[order]
        new = np.ones(len(at), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        tied = np.flatnonzero(~new)
        for place in (*range(16, SIZE - 8, 8), SIZE - 8):
            tied = tied[_words_at(padded, at[tied] + place) == _words_at(padded, at[tied - 1] + place)]
        new[:] = True
        new[tied] = False
        group = np.cumsum(new) - 1
        least = np.minimum.reduceat(doc[own], np.flatnonzero(new))
        flags[at] = doc[own] > least[group]
    return flags


def _bucket(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    names = ["doc", "hash", "start", "stop"]
    undo = zstandard.ZstdDecompressor()
    if key[0].as_py() < 0:
        spans = np.concatenate([np.frombuffer(undo.decompress(h.as_py()), np.int64).reshape(4, -1) for h in rows["head"]], 1)
        return pa.Table.from_arrays(_spans(*spans), names=names)
    head = np.concatenate([head_of(undo.decompress(h.as_py())) for h in rows["head"]])
    body = np.concatenate([np.frombuffer(undo.decompress(b.as_py()), np.uint8) for b in rows["body"]])
    stop = np.cumsum(head["len"], dtype=np.int64)
    head["key"] = anchor_keys(body, stop - head["len"] + head["off"])
    same, later = _first_holders(head, body)
    start = head["start"].astype(np.int64)
    out = [(head["doc"][later], head["hash"][later], start[later], start[later] + head["len"][later])]
    # One row a distinct segment, for anchors that have two of them or more.
    length = head["len"].astype(np.int64)
    begin = np.cumsum(length) - length
    left = np.flatnonzero(~later)
    _, pick = np.unique(same[left], return_index=True)
    one = left[pick]
    _, which, many = np.unique(head["key"][one], return_inverse=True, return_counts=True)
    one = one[many[which] > 1]
    text = _gather(body, begin[one], length[one])
    flags = repeated_suffixes(text, length[one], head["off"][one].astype(np.int64), head["doc"][one])
    step = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1
    if len(first):
        base = np.cumsum(length[one]) - length[one]
        segment = np.searchsorted(base, first, "right") - 1
        # Every row that holds the segment (all of one doc_id) loses the run.
        order = left[np.argsort(same[left], kind="stable")]
        lo, hi = (np.searchsorted(same[order], same[one[segment]], side) for side in ("left", "right"))
        run = np.repeat(np.arange(len(first)), hi - lo)
        entry = order[np.arange(len(run)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[run]]
        at = start[entry] + (first - base[segment])[run]
        out.append((head["doc"][entry], head["hash"][entry], at, at + (last - first)[run] + SIZE))
    release()
    return pa.Table.from_arrays(_spans(*[np.concatenate(x) for x in zip(*out, strict=True)]), names=names)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, hash): a row is named by its doc_id and 64 bits of a hash of its text."""
    return docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts as zstd frames, for the shuffle that meets them with their spans."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in portions(batches):
        frames = [press.compress((t.as_py() or "").encode()) for t in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), batch["hash"], pa.array(frames, pa.binary())], names=["doc_id", "hash", "frame"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: the text's bytes without its spans, and the counts."""
    undo = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for frame, spans in zip(batch["frame"], batch["spans"], strict=True):
            raw = undo.decompress(frame.as_py())
            kept, removed, runs, at = [], 0, 0, 0
            ends = sorted((s["start"], s["stop"]) for s in spans.as_py() or ())
            for start, stop in ends:
                if start > at or not runs:
                    kept.append(raw[at:start])
                    runs += 1
                    at = start
                if stop > at:
                    removed += stop - at
                    at = stop
            kept.append(raw[at:])
            out.append((len(raw), removed, runs, b"".join(kept)))
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedupe_strings(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept is the bytes left, which need not be whole characters."""
    docs = keyed(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, min(20, (size // BUCKET_BYTES).bit_length()))
    screen_bits = max(bits + 3, min(MOST_SCREEN_BITS, 1 + (size // ANCHOR_BYTES).bit_length()))
    # The bitmap of 2^MOST_SCREEN_BITS bits at most, and MOST_HOT keys, go to the executors.
    shared = spark.sparkContext.broadcast(screen(docs, bits, screen_bits))
    packed = docs.mapInArrow(_sent_segments(shared, bits, screen_bits), "bucket long, head binary, body binary")
    found = packed.groupBy("bucket").applyInArrow(_bucket, SPANS)
    spans = found.groupBy("doc", "hash").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).withColumnRenamed("hash", "of")
    texts = docs.mapInArrow(_pressed, "doc_id long, hash long, frame binary")
    joined = texts.join(spans, (F.coalesce("doc_id", F.lit(int(LAST))) == F.col("doc")) & (F.col("hash") == F.col("of")), "left")
    return joined.select("doc_id", "frame", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_strings(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
