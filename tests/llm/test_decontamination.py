import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa

from tessera.llm import decontamination as dc
from tessera.llm.textkit import text_bytes, words


def ws(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def grams(w):
    return Counter([tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else []))


def brute(docs, items):
    out = {}
    for d, text in docs:
        w = ws(text)
        for i, item in items:
            v = ws(item)
            if not v or not w:
                continue
            g, best = grams(v), (0, 0)
            for s in range(max(1, len(w) - len(v) + 1)):
                x = grams(w[s : s + len(v)])
                shared = sum((x & g).values())
                sim = shared / (sum(x.values()) + sum(g.values()) - shared)
                if sim > best[0]:
                    best = (sim, s)
            if best[0] >= 0.75:
                out[d, i] = best
    return out


def made(seed):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(60)}"
    items = [(k, " ".join(word() for _ in range(rnd.randrange(1, 50)))) for k in range(40)] + [(90, ""), (91, None), (92, "Only Three Words")]
    docs = []
    for k in range(120):
        body = [word() for _ in range(rnd.randrange(0, 120))]
        if k % 3 == 0:
            v = ws(items[rnd.randrange(40)][1])
            for _ in range(rnd.randrange(3)):
                v[rnd.randrange(len(v))] = word()
            cut = rnd.randrange(3)
            at = rnd.randrange(len(body) + 1)
            body[at:at] = [x.upper() for x in v[cut:]] if k % 2 else v[cut:]
        docs.append((k, " ".join(body)))
    return docs + [(200, None), (201, ""), (202, "only three words"), (203, "only three"), (204, items[0][1])], items


def test_matches_equal_brute_force(spark):
    for seed in (1, 2, 3):
        docs, items = made(seed)
        got = dc.contaminated(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        want = brute(docs, items)
        assert {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in got} == want
        assert all(r.hamming <= dc.RADIUS for r in got)


def test_blocks_and_clean_documents(spark, monkeypatch):
    docs, items = made(5)
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 7)
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, item_id int, similarity string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(spark, d, b).collect()} == set(want)
    left = dc.clean_documents(spark, d, b)
    assert left.columns == d.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({k for k, _ in docs} - {k for k, _ in want})
    assert dc.contaminated(spark, d, b.limit(0)).count() == 0 and dc.contaminated(spark, d.limit(0), b).count() == 0


def test_within_radius_share_a_block():
    rng = np.random.default_rng(0)
    zero = np.zeros(1, np.int64)
    for _ in range(50):
        a = rng.integers(0, 2**63, 1, dtype=np.uint64)
        b = a.copy()
        for bit in rng.choice(64, dc.RADIUS, replace=False):
            b ^= np.uint64(1) << np.uint64(bit)
        near = dc.block_keys(a, zero)[:, :, None] ^ dc.near_values()
        assert (near == dc.block_keys(b, zero)[:, :, None]).any()
    # The index selects: few of all values are near.
    a, b = (rng.integers(0, 2**63, 2000, dtype=np.uint64) for _ in range(2))
    apart = dc.block_keys(a, np.zeros(2000, np.int64)) ^ dc.block_keys(b, np.zeros(2000, np.int64))
    assert np.isin(apart & 0xFFFF, dc.near_values()).any(1).mean() < 0.06


def test_short_items_inside_documents(spark):
    docs = spark.createDataFrame([(1, "what is the Capital of France today"), (2, "the capital of a France"), (3, "yes"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "capital of france"), (8, "yes")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.start_word) for r in dc.contaminated(spark, docs, items).collect()} == {(1, 7, 3), (3, 8, 0)}


def test_spans_of_long_texts(monkeypatch):
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    start = np.sort(rng.integers(0, 2500, 400))
    stop = np.minimum(start + rng.integers(1, 700, 400), 3000)
    want = dc.window_prints(hashes, start, stop)
    assert want.tolist() == [int(dc.fingerprints(dc.signs(hashes[a:b]).sum(0, dtype=np.int64)[None])[0]) for a, b in zip(start, stop, strict=True)]
    monkeypatch.setattr(dc, "SPAN", 100)
    assert (dc.window_prints(hashes, start, stop) == want).all()


def test_items_of_any_length(spark):
    text = " ".join(f"w{k % 997}" for k in range(40_000))
    docs = spark.createDataFrame([(1, "before it " + text + " after it"), (2, text[: len(text) // 2])], "doc_id long, text string")
    found = dc.contaminated(spark, docs, spark.createDataFrame([(5, text)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.n_words, r.similarity) for r in found] == [(1, 40_000, 1.0)]


def test_tables(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in dc.op10_decontamination(spark, sf_dir).collect()}
    assert got == set(brute(docs, items)) and got
    assert text_bytes(pa.array([None, "a"]))[1].tolist() == [0, 0, 1] and len(words(*text_bytes(pa.array([""]))).hash) == 0


def test_long_items_take_near_linear_time():
    rnd = random.Random(4)
    item = [f"w{rnd.randrange(10**6)}" for _ in range(8000)]
    text = " ".join([f"v{k}" for k in range(500)] + item + [f"u{k}" for k in range(900)] + item[:4000] + ["x", "y"] + item[4000:])
    began = time.perf_counter()
    index = dc.build_index([7], [" ".join(item)])
    data, offsets = text_bytes(pa.array([text]))
    w = words(data, offsets, lower=True)
    start, size = dc.anchored_windows(index, w)
    assert 0 < len(start) < 12000 and (size == 8000).all()
    assert dc.matches(index, w) == [(0, 0, 500, 8000, 0, 1.0)]
    assert time.perf_counter() - began < 20
