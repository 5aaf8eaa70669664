import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard
from tessera.llm.graph import components
from tessera.llm.textkit import set_runs


def sets_of(rows):
    out = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        ws = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set()))
    return out


def brute(rows):
    sets, parent = sets_of(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    post = {}
    for i, s in enumerate(sets):
        for g in s:
            post.setdefault(g, []).append(i)
    counts = {}
    for at in post.values():
        for x in range(len(at)):
            for y in range(x):
                counts[at[y], at[x]] = counts.get((at[y], at[x]), 0) + 1
    for (i, j), shared in counts.items():
        if 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared):
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = min(least.get(r, d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def made(seed=3):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(400)}"
    rows = [(k, " ".join(word() for _ in range(rnd.randrange(0, 60)))) for k in range(200)]
    hub = " ".join(word() for _ in range(30))
    rows += [(300 + k, hub + " " + " ".join(word() for _ in range(rnd.randrange(2, 30)))) for k in range(150)]
    base = [word() for _ in range(80)]
    for k in range(150):
        copy = list(base)
        for _ in range(rnd.randrange(0, 3)):
            copy[rnd.randrange(80)] = word()
        rows.append((1000 + k, " ".join(copy)))
    for k in range(120):
        text = rows[rnd.randrange(len(rows))][1].split(" ")
        text[rnd.randrange(len(text))] = word()
        rows.append((2000 + k, " ".join(text).upper() if k % 2 else " ".join(text)))
    rows += [(5000, ""), (5001, None), (5002, "  \n"), (5003, "a b"), (5004, "A  b"), (5005, rows[0][1]), (5006, "a b c d e"), (5007, "a b c d e")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("wide,hub", [(32, 48), (6, 10)])
def test_join_matches_brute_force(spark, monkeypatch, wide, hub):
    monkeypatch.setattr(jaccard, "WIDE", wide)
    monkeypatch.setattr(jaccard, "HUB_DF", hub)
    rows = made()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string").repartition(3)
    got = sorted(tuple(r) for r in jaccard.jaccard_components(spark, df).collect())
    assert got == brute(rows)


def test_hot_columns_are_dealt_by_class(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HUB_DF", 10)
    monkeypatch.setattr(jaccard, "HOT_DF", 145)
    rows = made(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, hot, _ = jaccard.hubs(df, 30000)
    assert 0 < hot.sum() < len(hot)
    assert sorted(tuple(r) for r in jaccard.jaccard_components(spark, df).collect()) == brute(rows)


def test_join_on_small_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(tuple(r) for r in jaccard.jaccard_components(spark, docs).collect()) == brute(rows)
    assert jaccard.jaccard_components(spark, docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, None), (7, "a b"), (7, "a b")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id or -1) for r in jaccard.jaccard_components(spark, odd).collect())
    assert got == [(-1, 0, -1), (-1, 1, 7), (7, 1, 7), (7, 1, 7)]


def test_rows_without_id_link(spark):
    base = [f"w{k}" for k in range(60)]
    edited = lambda *at: " ".join(f"x{k}" if k in at else w for k, w in enumerate(base))
    rows = [(1, edited(0, 1, 2, 3)), (None, edited()), (2, edited(56, 57, 58, 59))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(spark, df).collect()} == {(1, 1), (None, 1), (2, 1)}


def test_sets_joined_on_text_hashes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_SENT", 3)
    rows = made(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.jaccard_components(spark, df).collect()) == brute(rows)


def test_long_sets_are_counted_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 16)
    monkeypatch.setattr(jaccard, "SLICE_POSTINGS", 64)
    rows = made(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.jaccard_components(spark, df).collect()) == brute(rows)
    for n in range(1, 300):
        for m in range(-(-3 * n // 4), n + 1):
            assert jaccard._levels(n, 16)[0] in jaccard._levels(m, 16)
    level = [r[0] for r in spark.range(1, 300).select(jaccard.level(F.col("id"))).collect()]
    assert level == [jaccard._levels(n, 16)[0] for n in range(1, 300)]


def test_representatives(spark):
    rnd = random.Random(2)
    text = lambda n: " ".join(f"w{rnd.randrange(900)}" for _ in range(n))
    one, two, three = text(40), text(40), text(40)
    rows = [(7, one, 1), (7, two, 1), (8, one, 2), (None, three, 3), (None, three, 3), (9, three + " end", 4), (5, "", 5), (5, None, 6), (4, "a b", 8), (4, "a b", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    left = sorted(((r.doc_id or -1), r.text or "", r.part) for r in jaccard.representatives(spark, df).collect())
    assert left == sorted([(7, one, 1), (7, two, 1), (9, three + " end", 4), (5, "", 5), (5, "", 6), (4, "a b", 7)])
    assert jaccard.representatives(spark, df.limit(0)).count() == 0


def test_bounds():
    for na in range(1, 60):
        for nb in range(1, 60):
            for shared in range(min(na, nb) + 1):
                if 4 * shared >= 3 * (na + nb - shared):
                    assert shared >= jaccard.needed(na, nb) and 4 * min(na, nb) >= 3 * max(na, nb)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)]
    got = {r.node: r.component for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {k: v for k, v in label.items() if k != v}


def test_rows_and_frequent_shingles_come_from_one_pass(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HUB_DF", 10)
    rows = made(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1).select("doc_id", "text", F.xxhash64("text").alias("t"))
    described, counted = jaccard.described(spark, docs, 6)
    texts = pa.array([t for _, t in rows], pa.string())
    sets = [s[a:b] for _, s, e in set_runs(texts) for a, b in zip(e[:-1], e[1:], strict=True)]
    assert sorted(len(s) for s in sets) == sorted(r.n for r in described.collect())
    classes = {s.tobytes(): s for s in sets}.values()
    times = Counter(int(k >> np.uint64(26)) for s in classes for k in s)
    assert {r.key: r.df for r in counted.collect()} == {k: n for k, n in times.items() if n > 10}


def test_representatives_shuffle_no_text(spark):
    rows = made(7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = jaccard.representatives(spark, df)
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
        names = {c for _, _, c in brute(rows)}
        assert sorted(r.doc_id for r in left.collect()) == sorted(names)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
