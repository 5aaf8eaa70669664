"""Line deduplication with a log-template tree.

A line's words are masked where they hold a digit, unless fewer than
`MIN_CONSTANT` of its words, or than the share `CONSTANT`, hold none: rows of numbers have
no template in common and stay as they are.  A fixed-depth tree parses a line: first by word count, then by `DEPTH` leading masked words.  In a leaf the
distinct masked lines are merged in order into templates: a line joins the
template that agrees with it in most positions, `AGREE` of them at least, and
positions that differ become variable.  A leaf of more than `LEAF_LINES` lines
is merged in blocks of about so many, then its blocks' templates by their forms
in the same way, while rounds lessen them by a fifth or more.  What is left of a
large leaf is merged part by part: lines that agree in AGREE of their positions
are equal in one of the parts that `cuts` names, so only those that share a part
meet in a task.  No line or template is left out at any size.

A template recurs if it stands in at least `MIN_DOCS` documents that differ
otherwise.  For each of its lines a document has `SKETCHES` sketches: smallest
hashes, in as many orders, of the shingles inside its other lines; the line
judged has no part in them.  Documents equal in all of them are one row.  A row
counts 1/n, where n rows of the template, itself included, have its sketch in
common, by the `NTH` smallest n of its sketches; so copies of a document, edited
or not, count as one together, whatever their number, and keep their lines for
the near-duplicate operator to find.  All lines of recurring templates are
dropped.  Lines under `MIN_WORDS` words are never dropped.

Lines travel as hashes.  Where only leaves are asked for, only the words that
name them are hashed; lines are then hashed in leaves that can hold a recurring
template.  Leaves with fewer than MIN_DOCS lines, or of copies of one text only,
cannot hold a recurring template and go before words are shuffled.  Both prunings
are joins; while there are at most MOST_SENT keys they are also broadcast, to
filter before the shuffle.

Nulls and odd rows: a null text stays null and has no lines; blank lines stay;
a text whose lines all go becomes empty and its row stays.  Repeated rows are
treated alike (rows are named by doc_id and text).  Empty tables give empty
results.  All columns are kept but one that has the name chosen for the count of
dropped lines; n_chars follows the text where it is present.  A text of any length is parsed in its task, where its lines and their
words are held at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import sent, table, written
from .textkit import SHINGLE, chunks, mix, portions, range_sums, roll, text_bytes, tidy, word_bounds

DEPTH = 3
DEEP = 8
AGREE = 0.8
MIN_WORDS = 3
MIN_CONSTANT, CONSTANT = 2, 1 / 3
MIN_DOCS = 5
SKETCHES = 12
NTH = 6
LEAF_LINES = 2048
FEW = 128  # lines up to which each is compared with all templates of its leaf, to the same result
MOST_SENT = 1 << 21

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_VARIABLE = np.uint64(0x5851F42D4C957F2D)
_ORDERS = np.random.default_rng(41).integers(0, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NONE = np.uint64(2**64 - 1)


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


class Outline:
    """The lines of a chunk that have MIN_WORDS words: text number, byte range and leaf.

    Only the words that name the leaf are hashed; lines_at() hashes those of the lines asked for.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self._data = data
        self._begin, self._end = word_bounds(data, offsets)
        variable = np.zeros(len(self._begin), bool)
        variable[np.searchsorted(self._begin, np.flatnonzero(_DIGIT[data]), "right") - 1] = True
        start = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
        start = start[start < len(data)]
        stop = np.append(start[1:], len(data))
        first = np.searchsorted(self._begin, start)
        count = np.diff(np.append(first, len(self._begin)))
        # Lines that are mostly numbers are no template: they are what they say.
        constant = np.add.reduceat(np.append(~variable, False).astype(np.int64), first)[: len(first)] if len(first) else first
        constant[count == 0] = 0
        masks = (constant >= MIN_CONSTANT) & (constant >= CONSTANT * count)
        self._variable = variable & np.repeat(masks, count)
        text = np.searchsorted(offsets[1:], start, "right")
        self._all = first, count, text
        full = count >= MIN_WORDS
        self._full = full
        self.start, self.stop, self.text = start[full], stop[full], text[full]
        self.first, self.count = first[full], count[full]
        self.leaf = self._hashed(np.arange(len(self.first)), DEPTH)

    def lines_at(self, which: np.ndarray) -> np.ndarray:
        """Hashes of the masked words of the lines of these ascending numbers."""
        return self._hashed(which, None)

    def _hashed(self, which: np.ndarray, depth: int | None) -> np.ndarray:
        """Hash of a line's word count and leading (all, if None) masked words."""
        count = self.count[which]
        n = count if depth is None else np.minimum(depth, count)
        until = np.cumsum(n)
        place = np.arange(n.sum()) - np.repeat(until - n, n)
        at = np.repeat(self.first[which], n) + place
        # The words' bytes are brought together, so that those between are not looked at.
        begin, end = self._begin[at], self._end[at]
        size = end - begin
        last = np.cumsum(size)
        near = self._data[np.arange(size.sum()) + np.repeat(begin - (last - size), size)]
        value = np.where(self._variable[at], _VARIABLE, mix(range_sums(near, last - size, last)))
        total = np.zeros(len(at) + 1, np.uint64)
        np.cumsum(mix(value + mix(place.astype(np.uint64) + np.uint64(11))), out=total[1:])
        return mix(total[until] - total[until - n] + mix(count.astype(np.uint64) + np.uint64(5 if depth is None else depth)))


class Lines(Outline):
    """An outline with all words masked and hashed, and the lines' hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        super().__init__(data, offsets)
        hashes = mix(range_sums(data, self._begin, self._end))
        self.masked = np.where(self._variable, _VARIABLE, hashes)
        first, count, text = self._all
        lines = self._leading(None, first, count)
        self.line = lines[self._full]
        some = count > 0
        self._of_sketch = hashes, first[some], count[some], text[some], lines[some]

    @property
    def deep(self) -> np.ndarray:
        return self._leading(DEEP, self.first, self.count)

    def sketches(self) -> np.ndarray:
        """Of each line, SKETCHES smallest shingle hashes of its text's other lines; copies of the line have no part."""
        hashes, first, count, text, line = self._of_sketch
        out = np.empty((len(self.line), SKETCHES), np.uint32)
        if not len(self.line):
            return out
        # Shingles inside lines; a line of fewer words is one shingle.
        inside = np.zeros(len(hashes), bool)
        place = np.arange(len(hashes)) - np.repeat(first, count)
        inside[place + SHINGLE <= np.repeat(count, count)] = True
        value = np.zeros(len(hashes), np.uint64)
        rolled = roll(hashes, SHINGLE)
        value[: len(rolled)] = rolled
        short = count < SHINGLE
        a, c = first[short], count[short]
        h = c.astype(np.uint64)
        for k in range(SHINGLE - 1):
            h = np.where(k < c, mix(h + hashes[np.minimum(a + k, len(hashes) - 1)]), h)
        value[a], inside[a] = h, True
        at = np.flatnonzero(inside)
        value, edge = value[at], np.searchsorted(at, first)
        top = np.searchsorted(text, np.unique(text))
        mine = np.searchsorted(text[top], self.text)
        size = np.diff(np.append(top, len(text)))
        for j, order in enumerate(_ORDERS):
            low = np.minimum.reduceat(value * order, edge)
            least = np.minimum.reduceat(low, top)
            holds = np.flatnonzero(low == np.repeat(least, size))
            owner = line[holds[np.searchsorted(text[holds], text[top])]]
            other = np.minimum.reduceat(np.where(line == np.repeat(owner, size), _NONE, low), top)
            # The smallest hashes have leading zeros: mixed before they are cut to 32 bits.
            out[:, j] = mix(np.where(self.line == owner[mine], other[mine], least[mine])) >> np.uint64(32)
        return out

    def _leading(self, depth: int | None, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Hash of a line's word count and leading (all, if None) masked words, from one running sum."""
        n = len(self.masked)
        place = np.zeros(n, np.int64)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place[at + np.repeat(first, count)] = at
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(self.masked + mix(place.astype(np.uint64) + np.uint64(11))), out=total[1:])
        until = first + (count if depth is None else np.minimum(depth, count))
        return mix(total[until] - total[first] + mix(count.astype(np.uint64) + np.uint64(5 if depth is None else depth)))


def _line_chunks(batch: pa.RecordBatch, kind: type[Outline] = Lines) -> Iterator[tuple[int, Outline]]:
    data, offsets = text_bytes(batch["text"])
    for i, j in chunks(offsets):
        yield i, kind(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


@tidy
def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leaf, n, lo, hi): per chunk and leaf the lines, and the least and largest checksum of their texts."""
    for batch in portions(batches):
        data, offsets = text_bytes(batch["text"])
        for i, x in _line_chunks(batch, Outline):
            if len(x.leaf):
                at = np.argsort(x.leaf, kind="stable")
                leaf, first, n = np.unique(x.leaf[at], return_index=True, return_counts=True)
                whole = np.zeros(int(x.text[-1]) + 1, np.int64)
                for t in np.unique(x.text).tolist():
                    own = data[offsets[i + t] : offsets[i + t + 1]]
                    whole[t] = zlib.crc32(own) << 31 ^ zlib.adler32(own)
                whole = whole[x.text[at]]
                yield pa.RecordBatch.from_arrays([_i64(leaf), pa.array(n, pa.int64()), pa.array(np.minimum.reduceat(whole, first)), pa.array(np.maximum.reduceat(whole, first))], names=["leaf", "n", "lo", "hi"])


def _among(shared, values: np.ndarray) -> np.ndarray:
    known = shared.value
    if not len(known):
        return np.zeros(len(values), bool)
    v = values.view(np.int64)
    return known[np.minimum(np.searchsorted(known, v), len(known) - 1)] == v


def _worded(shared):
    """(leaf, line, kind, codes) once per text and distinct line of the leaves sent (all, if None).

    kind has the text's sketches for the line.  codes has the words as 63-bit codes from 1, once per chunk and line.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            for _, x in _line_chunks(batch):
                _, at = np.unique(mix(x.line + mix(x.text.astype(np.uint64))), return_index=True)
                at = at[_among(shared, x.leaf[at])] if shared is not None else at
                if not len(at):
                    continue
                code = np.maximum(x.masked >> np.uint64(1), np.uint64(1))
                new = np.zeros(len(at), bool)
                new[np.unique(x.line[at], return_index=True)[1]] = True
                codes = [code[a : a + n].tobytes() if k else None for a, n, k in zip(x.first[at], x.count[at], new, strict=True)]
                kind = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * SKETCHES), pa.array(x.sketches()[at].ravel().view(np.int32)))
                yield pa.RecordBatch.from_arrays([_i64(x.leaf[at]), _i64(x.line[at]), kind, pa.array(codes, pa.binary())], names=["leaf", "line", "kind", "codes"])

    return run


@cache
def cuts(size: int) -> list[int]:
    """Where a line's words past the leaf's are cut: into one part more than positions may differ, so that a line equals its template in one of them."""
    most = sum((size - k) / size >= AGREE for k in range(1, size + 1))
    return np.linspace(min(DEPTH, size), size, most + 2).astype(int).tolist()


def rare_parts(rows: np.ndarray) -> list[list[int]]:
    """For each line the parts, as numbers, that it must have one of in common with any line that agrees with it.

    A line is cut into up to twice as many parts as positions may differ, and two
    more.  Lines that agree share all but as many parts as may differ; so those
    that a line has beyond that number, its most frequent ones here, need not be
    looked up, and an opening that all lines have brings none of them together.
    """
    size = rows.shape[1]
    most = len(cuts(size)) - 2
    begin = min(DEPTH, size)
    n_parts = max(min(size - begin, 2 * most + 2), 1)
    ends = np.linspace(begin, size, n_parts + 1).astype(int)
    number, often, n = np.empty((len(rows), n_parts), np.int64), [], 0
    for k, (i, j) in enumerate(pairwise(ends.tolist())):
        part = np.ascontiguousarray(rows[:, i:j])
        _, same, count = np.unique(part.view(f"V{8 * (j - i)}").ravel() if j > i else np.zeros(len(rows)), return_inverse=True, return_counts=True)
        number[:, k] = np.where((part >= 0).all(1), same + n, -1)
        often.append(count)
        n += len(count)
    rank = np.empty(n, np.int64)
    rank[np.argsort(np.concatenate(often), kind="stable")] = np.arange(n)
    order = np.sort(np.where(number >= 0, rank[number], n), axis=1)
    kept = (number >= 0).sum(1) - (n_parts - most) + 1
    return [row[: max(k, 0)] for row, k in zip(order.tolist(), kept.tolist(), strict=True)]


def merged(lines: list[np.ndarray]) -> tuple[list[int], np.ndarray]:
    """The template number of each line or form of a leaf, all of one length, merged in order, and the templates' forms.

    Variable positions are negative.  Beyond FEW lines only templates that share one of their rare parts with a line are compared with it.
    """
    if not lines:
        return [], np.empty((0, 0), np.int64)
    rows = np.stack(lines).astype(np.int64, copy=False)
    form = np.empty_like(rows)
    known: dict[int, list[int]] = {}
    out, n = [], 0
    for line, parts in zip(rows, rare_parts(rows) if len(rows) > FEW else [[0]] * len(rows), strict=True):
        near = np.array(sorted({t for part in parts for t in known.get(part, ())}), np.int64)
        same = ((form[near] == line) & (line >= 0)).mean(1) if len(near) else np.zeros(0)
        if len(near) and same.max() >= AGREE:
            best = int(near[same.argmax()])
            form[best][form[best] != line] = -1
        else:
            form[n] = line
            for part in parts:
                known.setdefault(part, []).append(n)
            best, n = n, n + 1
        out.append(best)
    return out, form[:n]


def merge_templates(lines: list[np.ndarray]) -> list[int]:
    """The template number of each line of a leaf, all of one length, merged in order."""
    return merged(lines)[0]


def _parsed(rows: pa.Table) -> pa.Table:
    """(leaf, item, template, codes) of one block; codes, 0 where variable, stand at the item that names the template."""
    rows = rows.sort_by("item")
    item = rows["item"].to_pylist()
    coded = [np.frombuffer(c.as_py(), np.int64) for c in rows["codes"]]
    number, form = merged([np.where(c > 0, c, -1) for c in coded])
    first: dict[int, int] = {}
    named = [first.setdefault(t, k) for t, k in zip(number, item, strict=True)]
    codes = [np.maximum(form[t], 0).tobytes() if k == first[t] else None for t, k in zip(number, item, strict=True)]
    return pa.table({"leaf": rows["leaf"], "item": rows["item"], "template": pa.array(named, pa.int64()), "codes": pa.array(codes, pa.binary())})


def _by_part(k: int):
    """(leaf, block, item, codes): block names the line's part k; a line without one, or with a variable word in it, is alone."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch["item"].to_numpy().copy()
            for n, codes in enumerate(batch["codes"]):
                words_of = np.frombuffer(codes.as_py(), np.int64)
                cut = cuts(len(words_of))
                if k + 1 < len(cut) and (part := words_of[cut[k] : cut[k + 1]]).all():
                    block[n] = mix(mix(part.view(np.uint64) + np.arange(1, len(part) + 1, dtype=np.uint64)).sum(keepdims=True, dtype=np.uint64)).view(np.int64)[0]
            yield pa.RecordBatch.from_arrays([batch["leaf"], pa.array(block), batch["item"], batch["codes"]], names=["leaf", "block", "item", "codes"])

    return run


def parsed_lines(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """(line, template) of distinct lines (leaf, line, codes)."""
    schema = "leaf long, item long, template long, codes binary"
    items, named, before = lines.select("leaf", F.col("line").alias("item"), "codes"), None, None

    def renamed(done: DataFrame) -> DataFrame:
        to = done.select("item", F.col("template").alias("to"))
        if named is None:
            return to.select(F.col("item").alias("line"), F.col("to").alias("template"))
        return written(named.join(to, F.col("template") == F.col("item")).select("line", F.col("to").alias("template")), spark)

    while True:
        large = written(items.groupBy("leaf").agg(F.count("*").alias("n")).where(f"n > {LEAF_LINES}").withColumnRenamed("leaf", "large"), spark)
        left = large.agg(F.sum("n")).first()[0] or 0
        keyed = items.join(large, F.col("leaf") == F.col("large"))
        rest = items.join(large, F.col("leaf") == F.col("large"), "left_anti")
        if left == 0 or (before is not None and left > 0.8 * before):
            break
        # Another deal each round: block numbers follow the number of items left.
        keyed = keyed.withColumn("block", F.pmod(F.xxhash64("item", "n"), F.ceil(F.col("n") / LEAF_LINES)))
        done = keyed.select("leaf", "block", "item", "codes").groupBy("leaf", "block").applyInArrow(_parsed, schema)
        done = written(done.unionByName(rest.select("leaf", "item", F.col("item").alias("template"), "codes")), spark)
        named = renamed(done)
        items, before = done.where("codes is not null").select("leaf", "item", "codes"), left
    done = rest.groupBy("leaf").applyInArrow(_parsed, schema)
    if left:
        words_of = keyed.agg(F.max(F.octet_length("codes"))).first()[0] // 8
        over, k = keyed.select("leaf", "item", "codes"), 0
        for k in range(len(cuts(words_of)) - 1):
            blocks = over.mapInArrow(_by_part(k), "leaf long, block long, item long, codes binary")
            step = written(blocks.groupBy("leaf", "block").applyInArrow(_parsed, schema), spark)
            # Small leaves keep their names until the end.
            named = renamed(step.unionByName(rest.select("leaf", "item", F.col("item").alias("template"), "codes")))
            over = step.where("codes is not null").select("leaf", "item", "codes")
        done = done.unionByName(over.select("leaf", "item", F.col("item").alias("template"), "codes"))
    return renamed(written(done, spark))


def _bounded(keys: DataFrame) -> np.ndarray | None:
    """The one column of keys as a sorted array if it has at most MOST_SENT rows, else None."""
    return np.sort(keys.toArrow().column(0).to_numpy()) if keys.count() <= MOST_SENT else None


def differing(kinds: DataFrame) -> DataFrame:
    """(template, n_docs) of the templates that stand in MIN_DOCS documents that differ otherwise; kinds: template, kind, n."""
    rows = kinds.groupBy("template").agg(F.sum("n").alias("n_docs"), F.count("*").alias("rows")).where(f"rows >= {MIN_DOCS}").select(F.col("template").alias("often"), "n_docs")
    each = kinds.join(rows, F.col("template") == F.col("often"), "left_semi").select("template", "kind", F.posexplode("kind").alias("j", "s"))
    shared = each.groupBy("template", "j", "s").agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    sizes = each.join(shared, ["template", "j", "s"], "left").groupBy("template", "kind").agg(F.sort_array(F.collect_list(F.coalesce("n_rows", F.lit(1)))).alias("sizes"))
    # Where a sum of fractions should be whole, rounding must not keep it below.
    found = sizes.groupBy("template").agg(F.sum(1 / F.col("sizes")[NTH - 1]).alias("differ")).where(f"differ >= {MIN_DOCS - 1e-6}")
    return found.join(rows, F.col("template") == F.col("often")).select("template", "n_docs")


def full_leaves(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(leaf), written: those that can hold a recurring template."""
    text = docs.select("text")
    leaves = text.mapInArrow(_leaves, "leaf long, n long, lo long, hi long").groupBy("leaf").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return written(leaves.where(f"n >= {MIN_DOCS} and lo <> hi").select("leaf"), spark)


def recurring_lines(spark: SparkSession, docs: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """(line, template, n_docs): hashes of the masked lines whose template recurs, and the template's documents.

    leaves is what full_leaves gives, if it is known.
    """
    text = docs.select("text")
    leaves = full_leaves(spark, docs) if leaves is None else leaves
    schema = "leaf long, line long, kind array<int>, codes binary"
    if (few := _bounded(leaves)) is not None:
        with sent(spark, few) as shared:
            seen = written(text.mapInArrow(_worded(shared), schema), spark)
    else:
        seen = written(text.mapInArrow(_worded(None), schema).join(leaves, "leaf", "left_semi"), spark)
    lines = written(seen.where("codes is not null").groupBy("leaf", "line").agg(F.first("codes").alias("codes")), spark)
    named = parsed_lines(spark, lines).withColumnRenamed("line", "named")
    # One row per template and kind of document, with the number of documents.
    kinds = seen.join(named, F.col("line") == F.col("named")).groupBy("template", "kind").agg(F.count("*").alias("n"))
    found = differing(written(kinds, spark)).withColumnRenamed("template", "recurring")
    return named.join(found, F.col("template") == F.col("recurring")).select(F.col("named").alias("line"), "template", "n_docs")


def _without(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> str:
    """A text without the byte ranges of whole lines."""
    keep = np.ones(len(data) + 1, np.int8)
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, stop, -1)
    keep = np.cumsum(edge[:-1]) == 0
    out = data[keep]
    # If the last line went, so does the break before it.
    if len(out) and len(stop) and stop[-1] == len(data) and data[-1] != 10 and out[-1] == 10:
        out = out[:-1]
    return out.tobytes().decode()


def _rewritten(drop_of, names: list[str], kind: type[Outline] = Lines):
    """The columns of docs and, under the last name, the lines dropped; drop_of gives the flags of a chunk's lines to drop."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            texts, n_dropped = batch["text"].to_pylist(), np.zeros(batch.num_rows, np.int64)
            data, offsets = text_bytes(batch["text"])
            for i, x in _line_chunks(batch, kind):
                drop = drop_of(batch, i, x)
                for t in np.unique(x.text[drop]):
                    own = drop & (x.text == t)
                    a, b = offsets[i + t], offsets[i + t + 1]
                    base = offsets[i]
                    texts[i + t] = _without(data[a:b], x.start[own] - (a - base), x.stop[own] - (a - base))
                    n_dropped[i + t] = own.sum()
            columns = {c: batch[c] for c in names[:-1]} | {"text": pa.array(texts, pa.string()), names[-1]: pa.array(n_dropped)}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return run


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores behind it if a column of that name, in any case, is there."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def _row_key():
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")


def dedupe_lines(spark: SparkSession, docs: DataFrame, count: str = "n_dropped") -> DataFrame:
    """docs with the lines of recurring templates taken out of text, and behind its columns their number, named `count`."""
    from pyspark.sql.types import LongType, StructField, StructType

    docs = docs.drop(count)
    leaves = full_leaves(spark, docs)
    lines = written(recurring_lines(spark, docs, leaves).select("line"), spark)
    names = [*docs.columns, count]
    schema = StructType([*docs.schema.fields, StructField(count, LongType())])
    if (few := _bounded(lines)) is not None:
        shared = spark.sparkContext.broadcast(few)
        of = _bounded(leaves)
        where_from = spark.sparkContext.broadcast(of) if of is not None else None

        def sent_of(_batch: pa.RecordBatch, _i: int, x: Outline) -> np.ndarray:
            # Lines of other leaves do not recur and need not be hashed.
            drop = np.ones(len(x.leaf), bool) if where_from is None else _among(where_from, x.leaf)
            at = np.flatnonzero(drop)
            drop[at] = _among(shared, x.lines_at(at))
            return drop

        out = docs.mapInArrow(_rewritten(sent_of, names, Outline), schema)
    else:
        # Too many lines to send: find each text's by a join and bring them back to it.
        def where(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in portions(batches):
                for i, x in _line_chunks(batch):
                    yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(i + x.text)), _i64(x.line)], names=["key", "at"])

        key, drop = free_name("key", names), free_name("drop", names)
        at = docs.select(_row_key().alias("key"), "text").mapInArrow(where, "key long, at long").distinct().join(lines, F.col("at") == F.col("line"), "left_semi")
        drops = at.groupBy("key").agg(F.collect_list("at").alias(drop)).withColumnRenamed("key", f"{key}_")

        def drop_of(batch: pa.RecordBatch, i: int, x: Lines) -> np.ndarray:
            gone = [set(d or ()) for d in batch[drop].slice(i, int(x.text[-1]) + 1 if len(x.text) else 0).to_pylist()]
            return np.array([v in gone[t] for v, t in zip(x.line.view(np.int64).tolist(), x.text.tolist(), strict=True)], bool)

        keyed = docs.withColumn(key, _row_key())
        out = keyed.join(drops, F.col(key) == F.col(f"{key}_"), "left").select(*docs.columns, drop).mapInArrow(_rewritten(drop_of, names), schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines dropped, and the size and digest of the text left."""
    out = dedupe_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_dropped", F.length(text).cast("long").alias("chars_left"), F.sha2(text, 256).alias("text_sha256"))
