import re
import zlib

import numpy as np
import pyarrow as pa

from tessera.llm import quality


def test_trees():
    g, h = np.array([3.0, 3, -2, -2, 5, 0, 0, 0]), np.ones(8)
    out = quality.shallow_tree(g, h)
    assert out[0] == out[1] > 0 > out[2] == out[3] and out[4] > 0
    gain, steps = quality.quadrant_tree(np.array([[1.0, -1], [-1, 1]]), np.ones((2, 2)))
    assert gain > 0 and steps[0, 0] > 0 > steps[0, 1]


def test_fit_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    assert quality.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in quality.op9_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in rows.items())
    test = [(rows[k].predicted, q) for k, q in labels.items() if rows[k].held_out]
    assert np.mean([p == q for p, q in test]) > 0.93


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 9), (1, "", 9), (None, "a b", 9), (2, "x " * 5000, 9), (2, "x " * 5000, 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (1, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    out = quality.scored(docs, model).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    blank = quality.AdditiveModel()
    assert {r.score for r in quality.scored(docs, blank).collect()} == {0.5}
    assert quality.train(docs, labels.limit(0)).tables == []
    assert quality.scored_digest(docs.limit(0), model).count() == 0
    assert [r.held_out for r in quality.scored_digest(docs, model).collect() if r.doc_id is None] == [False]


def test_measures_match_plain_counts():
    texts = ["The CAT sat, the CAT sat on 12 mats!\nThe end.\n\nThe end.", "", "x", "é è É | a;b", "AB cd AB cd " * 300 + "#*"]
    data, offsets = quality.text_bytes(pa.array(texts))
    got = dict(zip(quality.FEATURES, quality.measures(data, offsets).T, strict=True))
    for k, text in enumerate(texts):
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        n = max(len(ws), 1)
        want = {
            "capitals": len(re.findall("[A-Z]", text)) / max(len(re.findall("[A-Za-z]", text)), 1), "all_caps": sum(len(re.findall("[A-Z]", w)) > 1 and 2 * len(re.findall("[A-Z]", w)) > len(w.encode()) for w in ws) / n,
            "digits": len(re.findall("[0-9]", text)) / n, "commas": len(re.findall("[,;:]", text)) / n, "bars": text.count("|") / n, "distinct_words": len(set(ws)) / n, "line_words": len(ws) / (text.count("\n") + 1),
        }
        assert {m: got[m][k] for m in want} == (want if ws else dict.fromkeys(want, 0))
    w = quality.words(data, offsets)
    assert quality.distinct_words(w).tolist() == [len(set(re.findall(r"[^\x20\x09-\x0D]+", t))) for t in texts]
