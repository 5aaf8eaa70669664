import hashlib
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import periodic


def planted_words(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def all_runs(w):
    """(start, length, period) of all runs, every period at every place."""
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and not any(s <= i and j + q <= s + m and q % p == 0 for (s, m), p in found.items()):
                found[i, j - i + q] = q
            i = j
    return sorted((s, m, p) for (s, m), p in found.items())


def expected(doc_id, text):
    w = planted_words(doc_id, text)
    runs = sorted(all_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, start string, length int").repartition(2)
    got = sorted((r.doc_id, *[r[c] for c in periodic.RESULT.replace(" long", "").replace(" string", "").split(", ")[1:]]) for r in periodic.periodic_runs(df).collect())
    assert got == sorted((i, *expected(i, t)) for i, t in rows)
    return got


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(list("ab" if i % 3 else "abcd"), rng.integers(0, 160)))) for i in range(250)]
    for i in range(250, 400):  # periods planted in words, twice, next to and inside one another
        inner = [f"v{k}" for k in range(rng.integers(1, 5))] * int(rng.integers(1, 7))
        outer = (inner + [f"u{k}" for k in range(rng.integers(0, 4))]) * int(rng.integers(1, 9))
        rows.append((i, " ".join([f"x{k}" for k in range(rng.integers(0, 5))] + outer + inner + outer[: rng.integers(0, 9)])))
    got = check(spark, rows)
    assert sum(r[1] > 0 for r in got) > 200 and sum(r[1] > 1 for r in got) > 50


@pytest.mark.parametrize("n", [5, 6, 7, 8, 24])
def test_least_lengths(spark, n):
    check(spark, [(1, "a " * n), (2, "a b " * (n // 2)), (3, "a b c " * (n // 3)), (11, "wé " * n)])


def test_whole_table_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in periodic.op12_periodic(spark, sf_dir).collect()}
    short = [r for r in docs if len((r.text or "").split()) < 900]
    assert len(got) == len(docs) and len(short) > 150
    assert all(got[r.doc_id] == expected(r.doc_id, r.text) for r in short)
    assert sum(got[r.doc_id][0] > 0 for r in short) > 10


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "a " * 30, 1), (3, " \n\t", 1), (7, "b " * 9, 1), (7, "b " * 9, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs int")
    got = {(r.doc_id, r.n_runs, r.length, r.exponent_milli) for r in periodic.periodic_runs(df).collect()}
    assert got == {(1, 0, None, None), (2, 0, None, None), (3, 0, None, None), (None, 1, 30, 30000), (7, 1, 9, 9000)}
    assert periodic.periodic_runs(df).count() == 6 and periodic.periodic_runs(df.limit(0)).count() == 0


def test_long_texts_take_near_linear_time():
    rng = np.random.default_rng(5)
    for w in (np.zeros(400_000, np.uint64), rng.integers(0, 2, 300_000).astype(np.uint64), np.tile(rng.integers(0, 2**63, 7000).astype(np.uint64), 60)):
        began = time.perf_counter()
        runs = periodic.runs_of(np.append(w, np.uint64(2**63)), np.array([len(w)]))
        assert runs and time.perf_counter() - began < 30
    assert runs == [(0, 420_000, 7000)]


def test_pieces_of_a_collapsed_text(monkeypatch):
    data = np.frombuffer(b"one  two three\tfour", np.uint8)
    start, end = np.array([0, 5, 9, 15]), np.array([3, 8, 14, 19])
    for size in (1, 6, 10, 100):
        monkeypatch.setattr(periodic, "PIECE_BYTES", size)
        assert periodic.joined_digest(data, start, end) == hashlib.sha256(b"one two three four").hexdigest()
    assert periodic.joined_digest(data, start[:0], end[:0]) == hashlib.sha256(b"").hexdigest()
