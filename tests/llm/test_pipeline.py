import hashlib
import re
from collections import Counter

import __spark_entry__ as se
import corpus_pipeline as cp
from pyspark.sql import functions as F
from test_decontamination import brute as brute_leaks
from test_jaccard import brute as brute_components

from tessera.llm import mixing, quality, templates
from tessera.llm.shared import written


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        out = written(stage(spark, docs, sf_dir), spark)
        assert out.columns == columns
        before = {r.doc_id: r.text for r in docs.collect()}
        after = {r.doc_id: r.text for r in out.collect()}
        assert out.count() == len(after) and set(after) <= set(before)
        if name == "quality":
            model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            assert set(after) == {r.doc_id for r in quality.scored(docs, model).collect() if r.score >= 0.5}
        if name == "lines":
            assert set(after) == set(before)
            assert after == {r.doc_id: r.text for r in templates.dedupe_lines(spark, docs).collect()}
        if name == "near_duplicates":
            assert set(after) == {c for _, _, c in brute_components(list(before.items()))}
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(before) - set(after) == {d for d, _ in brute_leaks(list(before.items()), items)}
        if name != "lines":
            assert all(before[k] == v for k, v in after.items())
        docs = out
    rows = [tuple(r) for r in docs.select("doc_id", "source", "text").collect()]
    got = cp.run(spark, sf_dir)
    assert sorted((r.doc_id, r.copy, r["size"], round(r.target, 3)) for r in got.collect()) == sorted(brute_mix(rows))
    assert {r.doc_id: r.text for r in got.collect()}.items() <= {d: t for d, _, t in rows}.items()


def test_odd_rows_pass(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    odd = docs.limit(3).withColumn("text", F.lit(None).cast("string")).unionByName(docs.limit(2)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    rows = docs.unionByName(odd).withColumn("score", F.lit(1)).withColumn("n", F.lit("x")).withColumn("copies", F.lit(3))
    for k, (_, stage) in enumerate(cp.STAGES):
        rows = written(stage(spark, rows, sf_dir), spark)
        assert k == 4 or [tuple(r) for r in rows.select("score", "n", "copies").distinct().collect()] == [(1, "x", 3)]
    assert rows.count() > 0
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        empty = written(stage(spark, empty, sf_dir), spark)
    assert empty.count() == 0


def brute_mix(rows):
    """(doc_id, copy, size, target) of each copy of rows (doc_id, source, text)."""
    sizes = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, _, t in rows}
    total = Counter()
    for d, source, _ in rows:
        total[source] += sizes[d]
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sorted(total))}
    target, free, left = {}, set(total), mixing.SHARE * sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > mixing.MOST * total[s]}
        for s in full or free:
            target[s] = mixing.MOST * total[s] if full else level * weight[s]
            left -= target[s]
        free -= full or free
    out = []
    for d, source, _ in rows:
        rate = target[source] / total[source]
        draw = int(hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest()[:12], 16) / 2**48
        out += [(d, k, sizes[d], round(target[source], 3)) for k in range(int(rate) + (draw < rate % 1))]
    return out


def test_mix_emits_copies(spark, sf_dir):
    docs = cp.kept(spark, sf_dir)
    want = brute_mix([tuple(r) for r in docs.select("doc_id", "source", "text").collect()])
    got = se.queries()["pipeline_mix"](spark, sf_dir)
    assert set(docs.columns) < set(got.columns)
    assert sorted((r.doc_id, r.copy, r["size"], round(r.target, 3)) for r in got.collect()) == sorted(want)
    # Some documents are out and some are in twice.
    times = Counter(d for d, *_ in want)
    assert max(times.values()) > 1 and len(times) < docs.count()
