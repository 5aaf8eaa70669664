"""The one-scan profile and its sketches, and the recall of a trained model, against NumPy."""

import numpy as np
import pytest

from tessera.operators import profile
from tessera.plans import queries


def test_profile_is_one_scan_and_sketches_are_near(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, (4000, 12)).astype(float)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    want = {(p, m): len(np.unique(x[:, m * (12 // p) : (m + 1) * (12 // p)], axis=0)) for p in profile.divisors(12) for m in range(p)}
    exact = profile.unique_profile(rows, 12)
    assert {(r.parts, r.m): r.n_unique for r in exact.collect()} == want
    assert exact._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + exact._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 1
    sketch = {(r.parts, r.m): r.n_unique for r in profile.unique_profile(rows, 12, sketch=True).collect()}
    assert sketch.keys() == want.keys() and all(abs(sketch[k] - n) <= max(1, 0.064 * n) for k, n in want.items())  # four standard errors


def test_trained_recall_equals_numpy(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(8, 64))[rng.integers(0, 8, 150)] + 0.3 * rng.normal(size=(150, 64))).astype(np.float32)
    spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    v, asked = x.astype(float), np.arange(0, 150, queries.STEP)
    found = np.zeros((len(asked), 150))
    for m in range(queries.PARTS):
        s = v[:, m * 8 : (m + 1) * 8]
        c, codes = np.unique(s, axis=0)[: queries.KS].copy(), None
        while True:
            d = ((s[:, None] - c[None]) ** 2).sum(2)
            now = d.argmin(1)
            if codes is not None and (now == codes).all():
                break
            codes = now
            for k in range(len(c)):
                c[k] = s[now == k].mean(0) if (now == k).any() else s[d[np.arange(150), now].argmax()]
        found += ((s[asked][:, None] - c[codes][None]) ** 2).sum(2)
    near = lambda d, k: [set(np.lexsort((np.arange(150), np.round(row, 9)))[:k].tolist()) for row in d]
    truth = near(((v[asked][:, None] - v[None]) ** 2).sum(2), queries.TOP)
    recall = [len(a & b) / len(a) for a, b in zip(truth, near(found, 100), strict=True)]
    got = queries.trained_recall(spark, str(tmp_path)).first()
    assert got.n_queries == len(asked) and got.mean_recall == pytest.approx(np.mean(recall), abs=1e-6) and got.sd_recall == pytest.approx(np.std(recall), abs=1e-6)
