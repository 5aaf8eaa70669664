import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import suffixes as sx


def brute(rows, size=sx.SIZE):
    least = {}
    for d, t in rows:
        raw, key = (t or "").encode(), (d is None, d or 0)
        for k in range(len(raw) - size + 1):
            s = raw[k : k + size]
            least[s] = min(least.get(s, key), key)
    out = []
    for d, t in rows:
        raw, key = (t or "").encode(), (d is None, d or 0)
        gone = bytearray(len(raw))
        for k in range(len(raw) - size + 1):
            if least[raw[k : k + size]] < key:
                gone[k : k + size] = b"\1" * size
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((-1 if d is None else d, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(spark, df):
    out = sx.dedupe_strings(spark, df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in out)


def made(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(rnd.randrange(5, 40)) for _ in range(6)]
    rows = []
    for k in range(150):
        parts = [prose(rnd.randrange(0, 30)) for _ in range(3)]
        if rnd.random() < 0.6:
            s = rnd.choice(shared)
            cut = rnd.randrange(len(s) // 3 + 1)
            parts.insert(rnd.randrange(4), s[cut:] if k % 2 else s)
        rows.append((rnd.randrange(1000) * 10 + k % 10, " ".join(parts)))
    rows += [(20000 + k, rows[k][1]) for k in range(20)]
    rows += [(30000, "ab" * 200), (30001, "ab" * 100), (30002, "x" + "ab" * 60 + "y"), (30003, "a" * 49), (30004, "a" * 50), (30005, "a" * 51), (30006, "a" * 300)]
    rows += [(30007, None), (30008, ""), (None, rows[0][1]), (None, "nobody else has this text, " * 3), (30004, "b" * 70), (30004, "b" * 70), (30009, "b" * 60), (30010, "\0" * 60), (30011, "\0" * 70)]
    rnd.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    for seed in (1, 2, 3):
        rows = made(seed)
        df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int").repartition(4)
        assert got(spark, df) == brute(rows)


def test_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = brute(rows)
    assert got(spark, docs.repartition(3)) == want and any(r[2] for r in want)
    assert sx.dedupe_strings(spark, docs.limit(0)).count() == 0


def test_hot_anchors_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(sx, "HOT", 2)
    rows = made(4)
    assert got(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(6)) == brute(rows)
    monkeypatch.setattr(sx, "CHUNK_BYTES", 200)
    data, offsets = np.frombuffer("".join("abc"[k * k % 3] + chr(97 + k * 7 % 26) for k in range(900)).encode(), np.uint8), np.array([0, 30, 130, 1500, 1500, 1800])
    seen = []
    for part, own, i, place in sx.pieces(data, offsets):
        _, text, first, last, _ = sx.segments(part, own)
        for t, a, b in zip(text, first, last, strict=True):
            seen += [(i + int(t), place + k - int(own[t])) for k in range(a, b + 1)]
            assert (part[a : a + sx.SIZE] == data[offsets[i + t] + place + a - own[t] :][: sx.SIZE]).all()
    assert sorted(seen) == [(t, k) for t in range(5) for k in range(max(0, int(offsets[t + 1] - offsets[t]) - sx.SIZE + 1))]


def test_cover():
    assert {(a - b) % 16 for a in sx.COVER for b in sx.COVER} == set(range(16)) and len(sx.COVER) == 5


def test_segments_hold_every_suffix_once():
    raw = (b"abcab" * 40 + b"\0" * 60 + bytes(range(97, 123)) * 4, b"", b"q" * 55, b"z" * 10)
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    key, text, first, last, anchor = sx.segments(data, offsets)
    seen = sorted((int(t), k) for t, a, b in zip(text, first, last, strict=True) for k in range(a, b + 1))
    assert seen == [(t, int(offsets[t]) + k) for t, r in enumerate(raw) for k in range(len(r) - sx.SIZE + 1)]
    assert ((anchor >= last) & (anchor - first <= sx.SIZE - sx.GRAM)).all()


def test_rows_without_id_keep_their_names_apart(spark):
    # Two texts that agree in 32 bits of a hash; one of them has a copy.
    text = F.concat(F.md5(F.col("id").cast("string").cast("binary")), F.lit(" "), F.sha2(F.col("id").cast("string").cast("binary"), 256))
    pairs = spark.range(400_000).select(text.alias("t")).groupBy(F.hash("t").alias("h")).agg(F.collect_list("t").alias("ts")).where("size(ts) > 1")
    a, b = pairs.orderBy("h").first().ts[:2]
    rows = [(1, a), (None, a), (None, b)]
    assert got(spark, spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_anchors_are_hot_by_their_segments():
    rng = np.random.default_rng(8)
    letters = lambda n: rng.integers(97, 123, n, np.uint8).tobytes().decode()
    passage, batch = letters(200), lambda texts: pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])

    def hot(batches, least):
        keys = pa.Table.from_batches(sx._anchor_keys(0)(iter(batches)))
        return len(sx._screen_slice(0, 20, least)((pa.scalar(0),), keys)["hot"][0].as_py()) // 4

    # A passage in many packets, but in few documents of each: a bucket can hold its segments.
    many = [batch([letters(30) + passage + letters(30) for _ in range(2)]) for _ in range(300)]
    assert hot(many, sx.HOT) == 0 and hot(many, 600) > 0 and hot(many, 601) == 0
    # One that a single packet has in very many documents.
    assert hot([batch([letters(30) + passage + letters(30) for _ in range(500)])] * 2, 1000) > 0
