import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, size=8):
    ws = WORD.findall(text or "")
    n = len(ws)
    seen = {}
    for i in range(n - size + 1):
        seen.setdefault(tuple(ws[i : i + size]), []).append(i)
    cover, longest = set(), 0
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                cover |= set(range(i, i + size))
            for x in range(len(at)):
                for y in range(x):
                    k = size
                    while at[x] + k < n and ws[at[x] + k] == ws[at[y] + k]:
                        k += 1
                    longest = max(longest, k)
    maximal = set()
    for length in range(size, longest + 1):
        occ = {}
        for i in range(n - length + 1):
            occ.setdefault(tuple(ws[i : i + length]), []).append(i)
        for key, at in occ.items():
            if len(at) > 1:
                before = {ws[i - 1] if i else ("start", i) for i in at}
                after = {ws[i + length] if i + length < n else ("end", i) for i in at}
                if len(before) > 1 and len(after) > 1:
                    maximal.add(key)
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return {"n_words": n, "word_chars": sum(map(len, ws)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": dup, "n_repeat_words": len(cover), "longest_repeat": longest, "n_maximal_repeats": len(maximal), "base_failed": n < 20 or 100 * len(cover) > 30 * n}


def check(texts, size):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    got = repetition.judge(data, offsets, size)
    for k, t in enumerate(texts):
        for name, value in brute(t, size).items():
            if name != "base_failed":
                assert got[name][k] == value, (name, t)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "é", "a|", "\n", "\n\n"]), max_size=40).map(" ".join), min_size=1, max_size=5))
def test_judge_matches_brute_force(texts):
    check(texts, 3)


def test_repeats_that_end_with_the_text():
    check(["a a a a b a a a b", "b a a a c a a a b x a a a c", "a b c d a b c x a b c d"], 3)


def test_long_repeats_and_edges():
    para = " ".join(f"w{k}" for k in range(60))
    check([para + " x " + para, "", "\n", "a\n", "\na", "a b c d e f g h " * 7, para * 3, "x " * 100, "y", f"{para}\n{para}\nz"], 8)


def test_query_rows_and_odd_input(spark):
    rows = [(1, None), (2, ""), (3, "a " * 30), (4, " ".join(f"u{k}" for k in range(40))), (4, " ".join(f"u{k}" for k in range(40))), (None, "é # b")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, kept int")
    out = repetition.repetition_rules(df).collect()
    assert len(out) == len(rows)
    for r, (_, text) in zip(sorted(out, key=lambda r: (r.doc_id is None, r.doc_id or 0)), rows, strict=True):
        for name, value in brute(text).items():
            assert r[name] == value
    assert [r.kept for r in sorted(out, key=lambda r: r.doc_id or 0) if r.doc_id] == [False, False, False, True, True]
    assert repetition.repetition_rules(df.limit(0)).count() == 0


def test_each_limit_of_the_method_decides():
    fresh = iter(f"u{k}" for k in range(100_000))
    new = lambda n: " ".join(next(fresh) for _ in range(n))
    short, long = new(14), new(60)
    far = new(150)
    texts = [
        " ".join(f"{short} {new(37)}" for _ in range(8)),  # repeats cover 27 %, each of 14 words
        f"{long} {new(480)} {long}",  # they cover 20 %, with one of 60 words
        f"{far} {new(9700)} {far}",  # 150 words, under 2 % of a long text
        f"{short} {new(300)} {short}",
    ]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = repetition.judge(data, offsets)
    assert got["base_failed"].tolist() == [False] * 4 and got["kept"].tolist() == [False, False, True, True]
