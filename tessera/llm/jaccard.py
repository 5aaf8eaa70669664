"""N-gram Jaccard join: a blocked sparse product of the document by shingle incidence.

The incidence is cut into column blocks by shingle hash.  Its product with its
transpose is masked: only columns that can decide a pair are multiplied in full.
With a row's shingles ordered by (hub, hash), two sets with Jaccard of at least
t share a shingle among their first n - ceil(t n) + 1, so the first product
holds these postings alone.  Hubs are the shingles in most sets, counted
exactly over all sets; moving them last keeps frequent passages out of the
product.  The hub list only orders columns, so its size bound loses nothing.

Each block counts the columns that its pairs share, and where the last of them
stands; counts are summed over the blocks.  A pair goes when the sum, with what
either row has left behind its last shared column, is below the overlap that
the rows' sizes need.  Pairs left go when the bits in which two folded bitmaps
differ already exceed the allowed difference.  For the rest the overlap is
counted over the column blocks of the whole sets (longer sets have more blocks)
and summed.  Documents with equal sets are one row, a class, of the incidence.
All texts are cut into shingles twice: once for sizes, classes and the hubs' counts,
which share a shuffle, and once for the postings, whose order needs the hubs;
those of pairs that the bounds leave open are cut again for the exact overlap.

Columns with more than `WIDE` rows are first paired with `CENTERS` of their own
rows only, those that stand in the most wide columns: in a group of near copies
these are the ones with the fewest edits.  Only pairs of one size band whose
rows are then still in different components, and which leave room for the
overlap needed, are multiplied out, so that large groups of near copies stay
close to linear and no link between different components is lost.  What remains
quadratic is a wide column whose rows of one size band all begin with it and
still differ from each other too much to be linked.  A column in more than
`HOT_DF` sets is taken as wide without being gathered: its rows are dealt to
blocks by class.

Nulls and odd rows: a null or blank text has the empty set, links with nothing
and is its own component; fewer than five words make one shingle.  Repeated
rows share a class; links run over classes, so a null doc_id links like any
other and only never names a component that has another id.  An empty table
gives no rows.  Only doc_id and text are read.  Classes are named by 64 bits of
their shingles: among 10^9 different texts the odds of a false one are 3 %.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import sent, table, written
from .textkit import mix, portions, release, set_runs, tidy

NUM, DEN = 3, 4  # the similarity, 75 / 100
HUB_DF = 48
HOT_DF = 1 << 12
MOST_HUBS = 1 << 20
WIDE = 16
CENTERS = 4
BLOCK_POSTINGS = 1 << 17
SLICE_POSTINGS = 1 << 15
BLOCK_SHINGLES = 1 << 12
MOST_SENT = 1 << 21

POSTING = np.dtype([("h", "<u8"), ("c", "<i8"), ("n", "<u4"), ("at", "<u4")])


def classes_of(shingles: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A signed 64-bit name of each set between successive edges, by its size and members."""
    total = np.zeros(len(shingles) + 1, np.uint64)
    np.cumsum(mix(shingles), out=total[1:])
    return mix(total[edge[1:]] - total[edge[:-1]] + mix(np.diff(edge).astype(np.uint64))).view(np.int64)


def bitmap_of(shingles: np.ndarray) -> bytes:
    """Parities of shingle counts per residue, over the power of two next to the set's size (64 at least)."""
    bits = max(64, 1 << int(len(shingles)).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference, from two bitmaps; the longer one is folded."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), 0)
    return int(np.bitwise_count(x ^ y).sum())


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def needed(na, nb):
    """The least overlap of sets of these sizes with Jaccard of NUM / DEN."""
    return -(-NUM * (na + nb) // (NUM + DEN))


def _packed(parts: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
    keys = sorted(parts)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([np.concatenate(parts[k]).tobytes() for k in keys], pa.binary())], names=["block", "data"])


def _split(rows: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
    """rows dealt to blocks, one packed row per block."""
    small = len(block) and -(1 << 15) <= block.min() and block.max() < 1 << 15
    order = np.argsort(block.astype(np.int16) if small else block, kind="stable")
    rows, block = rows[order], block[order]
    edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, int)
    return _packed({int(block[i]): [rows[i:j]] for i, j in zip(edges, np.append(edges[1:], len(block)), strict=True)})


def _distinct(c: np.ndarray, shingles: np.ndarray, edge: np.ndarray, seen: set[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes, shingles, edges) of the sets that are not empty and of a class not seen, once each."""
    n = np.diff(edge)
    new = np.zeros(len(c), bool)
    new[np.unique(c, return_index=True)[1]] = True
    new &= n > 0
    if seen:
        new &= np.array([v not in seen for v in c.tolist()], bool)
    seen.update(c[new].tolist())
    if not new.all():
        shingles = shingles[np.repeat(new, n)]
    return c[new], shingles, np.concatenate([np.zeros(1, np.int64), np.cumsum(n[new])])


def _distinct_runs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each chunk of a batch, what _distinct leaves."""
    seen: set[int] = set()
    for _, shingles, edge in set_runs(batch["text"]):
        yield _distinct(classes_of(shingles, edge), shingles, edge, seen)


def _distinct_sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for cs, shingles, edge in _distinct_runs(batch):
        for k, c in enumerate(cs.tolist()):
            yield c, shingles[edge[k] : edge[k + 1]]


#: A document's row, or the packed shingles of a block.
DESCRIBED = "block long, data binary, doc_id long, t long, n long, c long, bits binary"


def _described(bits: int):
    """In one pass, DESCRIBED rows of documents, in blocks below 0, and all shingles by block of the hash range, as 32-bit keys, each set of a batch once."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = ("block", "data", "doc_id", "t", "n", "c", "bits")
        for batch in portions(batches):
            ns, cs, maps, sets, seen = [], [], [], [], set()
            for _, shingles, edge in set_runs(batch["text"]):
                c = classes_of(shingles, edge)
                ns.append(np.diff(edge))
                cs.append(c)
                maps += [bitmap_of(shingles[i:j]) if j > i else None for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                sets.append(_distinct(c, shingles, edge, seen)[1])
            if not batch.num_rows:
                continue
            n, c, every = np.concatenate(ns), np.concatenate(cs), np.concatenate(sets)
            m = batch.num_rows
            block = -1 - (np.arange(m) & ((1 << bits) - 1))
            columns = (pa.array(block), pa.nulls(m, kinds[1]), batch["doc_id"].cast(pa.int64()), batch["t"], pa.array(n), pa.array(c, mask=n == 0), pa.array(maps, pa.binary()))
            yield pa.RecordBatch.from_arrays(list(columns), names=names)
            if len(every):
                dealt = _split(((every >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32), (every >> np.uint64(64 - bits)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([dealt["block"], dealt["data"], *(pa.nulls(dealt.num_rows, k) for k in kinds[2:])], names=names)

    return run


def _frequent(bits: int, least: int):
    """The documents' rows as they are, and of a block of shingles those in more than `least` sets, with their number."""
    kinds = {"doc_id": pa.int64(), "t": pa.int64(), "n": pa.int64(), "c": pa.int64(), "bits": pa.binary()}

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return rows.select(list(kinds)).append_column("key", pa.nulls(rows.num_rows, pa.int64())).append_column("df", pa.nulls(rows.num_rows, pa.int64()))
        found = np.sort(np.concatenate([np.frombuffer(d.as_py(), np.uint32) for d in rows["data"]]))
        # Of sorted keys only those that stand again `least` places on are in more sets.
        value, count = np.unique(found[least:][found[least:] == found[:-least]] if least else found, return_counts=True)
        many = pa.array(((np.uint64(key[0].as_py()) << np.uint64(32)) | value.astype(np.uint64)).astype(np.int64))
        return pa.table({k: pa.nulls(len(many), t) for k, t in kinds.items()} | {"key": many, "df": pa.array(count.astype(np.int64) + least)})

    return run


def described(spark: SparkSession, docs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Written: (doc_id, t, n, c, bits) of each row of docs (doc_id, text, t), and (key, df) of the shingles in more than HUB_DF sets, by 2^bits blocks."""
    rows = docs.mapInArrow(_described(bits), DESCRIBED).groupBy("block")
    found = written(rows.applyInArrow(_frequent(bits, HUB_DF), "doc_id long, t long, n long, c long, bits binary, key long, df long"), spark)
    return found.where("n is not null").drop("key", "df"), found.where("df is not null").select("key", "df")


def block_bits(total: int) -> int:
    """So many bits of a hash deal a total of shingles to blocks of a bounded size each."""
    return max(6, min(24, (total // (8 * BLOCK_POSTINGS)).bit_length()))


def most_frequent(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the shingles of counted (key, df), the MOST_HUBS most frequent if there are more, and which are in more than HOT_DF sets."""
    most = counted.orderBy(F.col("df").desc(), "key").limit(MOST_HUBS).toArrow().sort_by("key")
    return most["key"].to_numpy(), most["df"].to_numpy() > HOT_DF


def hubs(docs: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted keys of the shingles in more than HUB_DF sets, which are in more than HOT_DF, and the keys' bits."""
    bits = block_bits(total)
    return *most_frequent(described(docs.sparkSession, docs.select("doc_id", "text", F.xxhash64("text").alias("t")), bits)[1]), bits


def _postings(known, hub_bits: int, row_bits: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub_keys, is_hot = known.value
        for batch in portions(batches):
            found, hot = [], []
            for c, s, edge in _distinct_runs(batch):
                n = np.diff(edge)
                own = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(s)) - edge[own]
                very = np.zeros(len(s), bool)
                if len(hub_keys) and len(s):
                    keys = (s >> np.uint64(32 - hub_bits)).astype(np.int64)
                    at = np.minimum(np.searchsorted(hub_keys, keys), len(hub_keys) - 1)
                    hub = hub_keys[at] == keys
                    very[hub] = is_hot[at[hub]]
                    # Hubs stand behind the set's other shingles.
                    before = np.zeros(len(s) + 1, np.int64)
                    np.cumsum(hub, out=before[1:])
                    hubs_before = before[:-1] - before[edge[own]]
                    place = np.where(hub, (n - np.diff(before[edge]))[own] + hubs_before, place - hubs_before)
                taken = place < prefix_length(n)[own]
                own = own[taken]
                rows = np.empty(len(own), POSTING)
                rows["h"], rows["c"], rows["n"], rows["at"] = s[taken], c[own], n[own], place[taken]
                found.append(rows)
                hot.append(very[taken])
            if sum(map(len, found)):
                rows, very = np.concatenate(found), np.concatenate(hot)
                # Prefixes are mostly the low end of the hash range: blocks are dealt by mixed hashes to be even.
                # Rows of a hot column are dealt by class to blocks of their own, -1 and below.
                dealt = (mix(np.where(very, rows["c"].view(np.uint64), rows["h"])) >> np.uint64(64 - row_bits)).astype(np.int64)
                yield _split(rows, np.where(very, -1 - dealt, dealt))

    return run


PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("shared", "<i4"), ("la", "<i4"), ("lb", "<i4")])


def _summed(pairs: np.ndarray) -> np.ndarray:
    """One entry a pair: shared columns added up, the last places of any."""
    if not len(pairs):
        return pairs
    pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
    edge = np.flatnonzero(np.r_[True, (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1])])
    out = pairs[edge]
    out["shared"] = np.add.reduceat(pairs["shared"], edge)
    for k in ("la", "lb"):
        out[k] = np.maximum.reduceat(pairs[k], edge)
    return out


def _multiplied(p: np.ndarray, wide: int) -> np.ndarray:
    """The product of narrow columns, given as postings sorted by column."""
    parts = []
    for d in range(1, wide):  # all pairs of a column's rows, by distance
        i = np.flatnonzero(p["h"][:-d] == p["h"][d:])
        if not len(i):
            break
        x, y = p[i], p[i + d]
        na, nb, at_a, at_b = (v.astype(np.int64) for v in (x["n"], y["n"], x["at"], y["at"]))
        ok = (DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb)) & (np.minimum(na - at_a, nb - at_b) >= needed(na, nb))
        turned = x["c"][ok] > y["c"][ok]
        one = np.empty(int(ok.sum()), PAIR)
        for k, v, w in (("a", x["c"], y["c"]), ("la", at_a, at_b)):
            one[k] = np.where(turned, w[ok], v[ok])
        for k, v, w in (("b", x["c"], y["c"]), ("lb", at_a, at_b)):
            one[k] = np.where(turned, v[ok], w[ok])
        one["shared"] = 1
        parts.append(one)
    return _summed(np.concatenate(parts)) if parts else np.empty(0, PAIR)


def _product(wide: int, size: int):
    """The product of one block, `size` postings at a time: pairs of columns of up to `wide` rows, and the rows of wider ones.

    Blocks below 0 hold parts of hot columns: all their rows count as those of wide ones.
    """

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        p = np.concatenate([np.frombuffer(d.as_py(), POSTING) for d in rows["data"]])
        p = p[np.lexsort((p["c"], p["n"], p["h"]))]
        p = p[np.r_[True, (p["h"][1:] != p["h"][:-1]) | (p["c"][1:] != p["c"][:-1])]]
        edge = np.flatnonzero(np.r_[True, p["h"][1:] != p["h"][:-1], True])
        width = np.repeat(np.diff(edge), np.diff(edge))
        if key[0].as_py() < 0:
            width = np.full(len(p), wide + 1)
        rest, p = p[width > wide], p[(width > 1) & (width <= wide)]
        edge = np.flatnonzero(np.r_[True, p["h"][1:] != p["h"][:-1], True]) if len(p) else np.zeros(1, np.int64)
        cuts = np.unique(edge[np.searchsorted(edge, np.arange(0, len(p) + size, size).clip(max=len(p)))])
        pairs = _summed(np.concatenate([np.empty(0, PAIR), *(_multiplied(p[i:j], wide) for i, j in zip(cuts[:-1], cuts[1:], strict=True))]))
        release()
        no = lambda n, t: pa.nulls(n, t)
        long, short, n, m = pa.int64(), pa.int32(), len(pairs), len(rest)
        columns = [
            (pa.array(pairs["a"]), pa.array(rest["c"])), (pa.array(pairs["b"]), no(m, long)), (pa.array(pairs["shared"]), no(m, short)), (pa.array(pairs["la"]), no(m, short)),
            (pa.array(pairs["lb"]), no(m, short)), (no(n, long), pa.array(rest["h"].view(np.int64))), (no(n, short), pa.array(rest["n"].astype(np.int32))), (no(n, short), pa.array(rest["at"].astype(np.int32))),
        ]
        return pa.Table.from_arrays([pa.concat_arrays(c) for c in columns], names=["a", "b", "shared", "la", "lb", "h", "n", "at"])

    return run


@tidy
def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        na, nb = batch["na"].to_numpy(), batch["nb"].to_numpy()
        most = na + nb - 2 * needed(na, nb)
        keep = [differing_bits(x.as_py(), y.as_py()) <= m for x, y, m in zip(batch["xa"], batch["xb"], most, strict=True)]
        yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(keep, pa.bool_()))


@tidy
def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared = []
        for x, y in zip(batch["sa"], batch["sb"], strict=True):
            s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            at = np.minimum(np.searchsorted(t, s), len(t) - 1)
            shared.append(int((t[at] == s).sum()) if len(t) else 0)
        yield pa.RecordBatch.from_arrays([*(batch[k] for k in ("a", "b", "na", "nb")), pa.array(shared, pa.int64())], names=["a", "b", "na", "nb", "shared"])


def level(n):
    """A set of n shingles has 2^level column blocks of about BLOCK_SHINGLES."""
    blocks = F.floor((n + (BLOCK_SHINGLES - 1)) / BLOCK_SHINGLES)
    return F.when(blocks <= 1, 0).otherwise(F.length(F.bin(blocks - 1)))


def _levels(n: int, size: int) -> list[int]:
    """The levels at which a set of n shingles meets the sets that its size allows."""
    one = lambda m: max(0, -(-m // size) - 1).bit_length()
    return sorted({one(n), one(DEN * n // NUM)})


def _set_blocks(wanted, size: int):
    """(c, level, block, s): the sets of the texts wanted (all, if None), cut into column blocks of about `size`."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = wanted.value if wanted is not None else None
        for batch in portions(batches):
            if texts is not None:
                got = batch["t"].to_numpy()
                batch = batch.filter(pa.array(texts[np.minimum(np.searchsorted(texts, got), len(texts) - 1)] == got))
            out = []
            for c, s in _distinct_sets(batch):
                for depth in _levels(len(s), size):
                    cut = np.searchsorted(s, np.arange(1, 1 << depth, dtype=np.uint64) << np.uint64(64 - depth)) if depth else []
                    out += [(c, depth, k, part.tobytes()) for k, part in enumerate(np.split(s, cut))]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)], names=["c", "level", "block", "s"])

    return run


def linked(spark: SparkSession, docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b), written: those of the candidate pairs (a, b, shared, la, lb) of classes whose sets have the similarity.

    classes is (c, n, t, bits, wide); wide counts the row's columns that `shared` leaves out.
    """
    side = lambda k: classes.select(F.col("c").alias(f"c{k}"), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"x{k}"), F.col("wide").alias(f"w{k}"))
    summed = pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("la").alias("la"), F.max("lb").alias("lb"))
    known = summed.join(side("a"), F.col("a") == F.col("ca")).join(side("b"), F.col("b") == F.col("cb"))
    most = F.col("shared") + F.least("wa", "wb") + F.least(F.col("na") - 1 - F.col("la"), F.col("nb") - 1 - F.col("lb"))
    known = known.where((NUM + DEN) * most >= NUM * (F.col("na") + F.col("nb")))
    left = written(known.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(_plausible, "a long, b long, na long, nb long"), spark)
    nodes = left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct()
    texts = written(nodes.join(classes, F.col("node") == F.col("c")).select("t").distinct(), spark)
    schema = "c long, level int, block int, s binary"

    def counted(sets: DataFrame) -> DataFrame:
        # A class's set may come from several batches; sets of a class are equal.
        sets = sets.groupBy("c", "level", "block").agg(F.first("s").alias("s"))
        side = lambda k: sets.select(*[F.col(v).alias(f"{v}{k}") for v in ("c", "level", "block", "s")])
        at = left.withColumn("level", F.greatest(level(F.col("na")), level(F.col("nb"))))
        at = at.withColumn("block", F.explode(F.sequence(F.lit(0), F.expr("shiftleft(1, level) - 1"))))
        on = lambda k: (F.col(k) == F.col(f"c{k}")) & (F.col("level") == F.col(f"level{k}")) & (F.col("block") == F.col(f"block{k}"))
        both = at.join(side("a"), on("a")).join(side("b"), on("b")).select("a", "b", "na", "nb", "sa", "sb")
        total = both.mapInArrow(_overlaps, "a long, b long, na long, nb long, shared long").groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
        return written(total.where(DEN * F.col("shared") >= NUM * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b"), spark)

    if (count := texts.count()) == 0:
        return left.select("a", "b")
    if count > MOST_SENT:
        return counted(docs.join(texts.withColumnRenamed("t", "wanted"), F.col("t") == F.col("wanted"), "left_semi").mapInArrow(_set_blocks(None, BLOCK_SHINGLES), schema))
    with sent(spark, np.sort(texts.toArrow()["t"].to_numpy())) as wanted:  # 16 MB at most
        return counted(docs.mapInArrow(_set_blocks(wanted, BLOCK_SHINGLES), schema))


def center_pairs(wide: DataFrame, often: DataFrame) -> DataFrame:
    """Candidates (a, b) of wide columns' rows (c, h, n, at) with their column's centers; often has a row's number of wide columns (row, columns).

    A column's centers are the rows in the most wide columns, one of each of CENTERS hash classes.
    """
    ranked = wide.join(often, F.col("c") == F.col("row")).withColumn("r", F.struct((-F.col("columns")).alias("order"), "c", "n", "at"))
    group = F.pmod(F.xxhash64("c"), F.lit(CENTERS))
    # Minima are taken map-side: one row per column and task is shuffled.
    centers = ranked.groupBy(F.col("h").alias("of")).agg(F.array_compact(F.array(*[F.min(F.when(group == k, F.col("r"))) for k in range(CENTERS)])).alias("centers"))
    # Read as a table, not as an aggregate by h, the join below can be split where a column is hot.
    centers = written(centers, wide.sparkSession)
    fits = lambda x: (
        (x["c"] != F.col("c")) & (DEN * F.least(x["n"], "n") >= NUM * F.greatest(x["n"], "n"))
        & ((NUM + DEN) * F.least(x["n"] - x["at"], F.col("n") - F.col("at")) >= NUM * (x["n"] + F.col("n")))
    )
    near = wide.join(centers, F.col("h") == F.col("of")).select("c", F.transform(F.filter("centers", fits), lambda x: x["c"]).alias("near"))
    return near.select("c", F.explode("near").alias("x")).select(F.least("c", "x").alias("a"), F.greatest("c", "x").alias("b"))


def crossed_pairs(wide: DataFrame, label: DataFrame) -> DataFrame:
    """Candidates (a, b) of wide columns' rows that are in different components (label: node, component) and in reach of each other's size."""
    wide = wide.join(label, F.col("c") == F.col("node"), "left").select("c", "h", "n", "at", F.coalesce("component", "c").alias("part"))
    open_columns = wide.groupBy("h").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select(F.col("h").alias("oh"))
    wide = wide.join(open_columns, F.col("h") == F.col("oh"), "left_semi").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM))))
    x = wide.select("h", "band", *[F.col(k).alias(f"{k}1") for k in ("c", "n", "at", "part")])
    # Sizes in reach are of the same band or of the next.
    y = wide.select(F.col("h").alias("h2"), F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band2"), F.col("band").alias("own"), *[F.col(k).alias(f"{k}2") for k in ("c", "n", "at", "part")])
    fits = "h = h2 and band = band2 and part1 <> part2 and (own > band or c1 < c2) and 4 * least(n1, n2) >= 3 * greatest(n1, n2) and 7 * least(n1 - at1, n2 - at2) >= 3 * (n1 + n2)"
    return x.join(y, F.expr(fits)).select(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b"))


def _uncounted(pairs: DataFrame) -> DataFrame:
    return pairs.distinct().select("a", "b", F.lit(0).alias("shared"), F.lit(-1).alias("la"), F.lit(-1).alias("lb"))


def classified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, t, n, part, component_id) for each row of docs: a hash of its text, its set's size, its component and that one's least doc_id.

    part is null, and component_id is the row's own id, where the set is empty.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    # Words of less than six bytes make more shingles than this, and blocks as many times larger.
    hub_bits = block_bits(int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6)
    rows, counted = described(spark, docs, hub_bits)
    # One row a class; bitmaps of a class are equal.
    classes = rows.where("n > 0").groupBy("c").agg(F.first("n").alias("n"), F.min("doc_id").alias("least_id"), F.min("t").alias("t"), F.first("bits").alias("bits"))
    classes = written(classes, spark)
    rows = rows.drop("bits")
    total = int(classes.agg(F.sum("n")).first()[0] or 0)
    keys, hot = most_frequent(counted)
    bits = max(6, min(24, (total // DEN // BLOCK_POSTINGS).bit_length() + 1))
    with sent(spark, (keys, hot)) as known:  # 9 MB at most
        blocks = docs.select("text").mapInArrow(_postings(known, hub_bits, bits), "block long, data binary")
        product = written(blocks.groupBy("block").applyInArrow(_product(WIDE, SLICE_POSTINGS), "a long, b long, shared int, la int, lb int, h long, n int, at int"), spark)
    pairs = product.where("b is not null").select("a", "b", "shared", "la", "lb")
    wide = product.where("h is not null").select(F.col("a").alias("c"), "h", "n", "at")
    if some := not wide.isEmpty():
        in_wide = written(wide.groupBy("c").agg(F.count("*").alias("columns")).withColumnRenamed("c", "row"), spark)
        pairs = pairs.unionByName(_uncounted(center_pairs(wide, in_wide)))
        classes = written(classes.join(in_wide, F.col("c") == F.col("row"), "left").select("c", "n", "least_id", "t", "bits", F.coalesce("columns", F.lit(0)).alias("wide")), spark)
    else:
        classes = classes.withColumn("wide", F.lit(0))
    edges = linked(spark, docs, classes, pairs)
    label = components(spark, edges)
    if some:
        more = linked(spark, docs, classes.withColumn("wide", F.col("n")), _uncounted(crossed_pairs(wide, label)))
        if not more.isEmpty():
            label = components(spark, edges.unionByName(more))
    parts = classes.join(label, F.col("c") == F.col("node"), "left").select(F.col("c").alias("cls"), F.coalesce("component", "c").alias("part"), "least_id")
    names = parts.groupBy("part").agg(F.min("least_id").alias("least")).withColumnRenamed("part", "of")
    named = parts.join(names, F.col("part") == F.col("of")).select("cls", "part", "least")
    return rows.join(named, F.col("c") == F.col("cls"), "left").select("doc_id", "t", "n", "part", F.coalesce("least", "doc_id").alias("component_id"))


def jaccard_components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs."""
    return classified(spark, docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def representatives(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with one row of each component: of the smallest doc_id, then of the least text hash; of equal ones the least row.

    Rows without words are components of their own and all stay.
    """
    found = classified(spark, docs).where("n > 0")
    rows = written(found.groupBy("part", "doc_id", "t").agg(F.count("*").alias("rows")), spark)
    least = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")).alias("x"), F.sum("rows").alias("of_all")).where("of_all > 1")
    # Read as a table, not as an aggregate by part, the join below can be split where a component is large.
    least = written(least.select(F.col("part").alias("of"), "x"), spark)
    first = F.col("doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("t") == F.col("x.t"))
    # What goes is named, not what stays: it is mostly less, and while it is sent no text is shuffled.
    gone = rows.join(least, F.col("part") == F.col("of")).select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"), first.alias("__first"), "rows").where("not __first or rows > 1")
    gone = written(gone.drop("rows"), spark)
    named = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__t"))
    small = lambda keys: F.broadcast(keys) if keys.count() <= MOST_SENT else keys
    kept = docs.join(small(gone.select("__id", "__t")), named, "left_anti")
    again = gone.where("__first").select("__id", "__t")
    if again.isEmpty():
        return kept
    one = docs.join(small(again), named).groupBy("__id", "__t").agg(F.min(F.struct(*[F.col(c) for c in docs.columns])).alias("x"))
    return kept.unionByName(one.select("x.*"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, table(spark, sf_dir, "documents"))
