import hashlib

import duckdb
import numpy as np
import pytest

from tessera.llm import clustering as cl

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance string"


def plain(rows, k, rounds):
    """Lloyd rounds by full search: {vec_id: (cluster, distance)} and the centroids."""
    kept = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), i, [int(np.floor(256 * float(np.float32(v)))) for v in x]) for i, x in rows)
    x = np.array([v for _, _, v in kept], object)
    c = x[:k].copy()
    for step in range(rounds + 1):
        d = np.array([[int(((a - b) ** 2).sum()) for b in c] for a in x], object)
        near = [min(range(len(c)), key=lambda j: (row[j], j)) for row in d]
        if step < rounds:
            for j in range(len(c)):
                mine = [v for v, n in zip(x, near, strict=True) if n == j]
                if mine:
                    c[j] = sum(mine) // len(mine)
    return {i: (n, row[n]) for (_, i, _), n, row in zip(kept, near, d, strict=True)}, c


@pytest.mark.parametrize("spread", [0.03, 1.0, 60000.0])
def test_equals_full_search(spark, spread):
    rng = np.random.default_rng(int(spread))
    middles = rng.normal(size=(6, 8))
    rows = [(i, (middles[i % 6] + spread * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # equal vectors: ties everywhere
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    found, centroids = cl.cluster(df, k=16, rounds=6, dimension=8)
    want, c = plain(rows, 16, 6)
    assert {r.vec_id: (r.cluster, r.distance) for r in found.collect()} == want
    assert centroids.tolist() == c.tolist()


def test_bounds_spare_distances():
    rng = np.random.default_rng(1)
    middles = rng.integers(-4000, 4000, (40, 16))
    x = middles[rng.integers(0, 40, 2000)] + rng.integers(-90, 90, (2000, 16))
    near, low, d = cl.scanned(x, middles, 10)
    after = middles + rng.integers(-9, 9, middles.shape)
    moves = np.sqrt(((after - middles) ** 2).sum(1)) * (1 + cl.SLACK)
    n2, low2, used, d2 = cl.bounded(x, after, *cl.moved_bounds(near, low, moves, 5))
    full = cl.distances(x, after)
    assert (n2[:, 0] == full.argmin(1)).all() and (d2 == full.min(1)).all() and (used == 0).mean() > 0.9
    # Every bound is one: of the remembered centroids, and of all that are not.
    root = np.sqrt(full)
    assert (low2[:, :-1] <= np.take_along_axis(root, n2[:, 1:], 1)).all()
    np.put_along_axis(root, n2, np.inf, 1)
    assert (low2[:, -1] <= root.min(1)).all()


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0] * 4), (1, [1.0] * 4), (None, [2.0] * 4), (2, None), (3, [1.0] * 3), (4, [None, 1.0, 1.0, 1.0]), (5, [nan, 1.0, 1.0, 1.0]), (6, [inf, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    found, centroids = cl.cluster(df, k=5, rounds=2, dimension=4)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in found.collect()) == [("1", 0, 0), ("1", 0, 0), ("None", 2, 0)] and len(centroids) == 3
    assert cl.cluster(df.limit(0), dimension=4)[0].count() == 0
    with pytest.raises(Exception, match="beyond"):
        cl.cluster(spark.createDataFrame([(1, [1e9] * 4, "", "")], SCHEMA), dimension=4)[0].collect()


def test_sql_agrees(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    found = con.execute(cl.OP11_SQL)
    names = [d[0] for d in found.description]
    df = cl.op11_clustering(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(found.fetchall())
