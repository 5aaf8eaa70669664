import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import templates as tp
from tessera.llm.textkit import text_bytes


def ws(line):
    return re.findall(r"[^\x20\x09-\x0D]+", line)


def prose(rnd, n):
    return " ".join(f"v{rnd.choice('abcdefghij')}{rnd.choice('klmnopqr')}{rnd.choice('stuvwxyz')}{rnd.choice('abcdefg')}" for _ in range(n))


def made(seed=0):
    rnd = random.Random(seed)
    docs = []
    for k in range(60):
        lines = [prose(rnd, rnd.randrange(4, 30)) for _ in range(rnd.randrange(1, 6))]
        if k % 2:
            lines.insert(rnd.randrange(len(lines) + 1), f"Posted on {rnd.randrange(28)} May 20{rnd.randrange(10, 24)} by the site editor team")
        if k % 3 == 0:
            lines.append("All of this is licensed to " + prose(rnd, 1) + " under terms found at the usual place below")
        docs.append((k, "\n".join(lines)))
    whole = "\n".join(prose(rnd, 25) for _ in range(6))
    docs += [(200 + k, whole) for k in range(30)]
    return docs + [(300, None), (301, ""), (302, "\n\n"), (303, "ok\nyes sir"), (0, docs[0][1])]


@pytest.mark.parametrize("sent", [1 << 21, -1])
def test_recurring_lines_go_and_copies_stay(spark, monkeypatch, sent):
    monkeypatch.setattr(tp, "MOST_SENT", sent)
    docs = made()
    df = spark.createDataFrame([(i, t, len(t or ""), 7) for i, t in docs], "doc_id long, text string, n_chars int, n_dropped int").repartition(3)
    out = tp.dedupe_lines(spark, df).collect()
    assert len(out) == len(docs) and Counter(r.doc_id for r in out) == Counter(i for i, _ in docs)
    gone = re.compile(r"Posted on|All of this is licensed")
    text = dict(docs)
    for r in out:
        if text[r.doc_id] is None:
            assert r.text is None
            continue
        assert r.text == "\n".join(x for x in text[r.doc_id].split("\n") if not gone.match(x))
        assert r.n_dropped == sum(bool(gone.match(x)) for x in text[r.doc_id].split("\n")) and r.n_chars == len(r.text)


def test_large_leaves(spark, monkeypatch):
    monkeypatch.setattr(tp, "LEAF_LINES", 4)
    rnd = random.Random(2)
    docs = [(k, "\n".join(["the same lead " + prose(rnd, 9), "the same lead line that everyone has in the page", prose(rnd, 12)])) for k in range(40)]
    out = tp.dedupe_lines(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r.n_dropped == 1 and "everyone" not in r.text for r in out)
    assert tp.dedupe_lines(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_hashes_follow_masked_words():
    texts = ["a b c 12\nx a b c 13x", "", "a  b\tc 99\n\n a b d 1\n", None, "a b c 1", "q r s t u v w x y z"]
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    x = tp.Lines(data, offsets)
    names = []
    for t, text in enumerate(texts):
        for line in (text or "").split("\n"):
            if len(ws(line)) >= tp.MIN_WORDS:
                names.append((t, tuple("#" if re.search(r"\d", v) else v for v in ws(line))))
    assert x.text.tolist() == [t for t, _ in names]
    for hashes, cut in ((x.line, None), (x.leaf, tp.DEPTH), (x.deep, tp.DEEP)):
        ids = {}
        for (_, v), h in zip(names, hashes.tolist(), strict=True):
            assert ids.setdefault((len(v), v[:cut]), h) == h
        assert len(set(ids.values())) == len(ids)


def test_merge():
    lines = [np.array(v) for v in ([1, 2, 3, 4, 5], [1, 2, 3, 4, 9], [1, 2, 8, 7, 6], [1, 2, 3, 4, 7])]
    assert tp.merge_templates(lines) == [0, 0, 1, 0]


@pytest.mark.parametrize("n_docs,n_passage,n_other", [(20, 60, 100), (20, 150, 100), (5, 60, 250)])
def test_long_passages_in_short_documents(spark, n_docs, n_passage, n_other):
    rnd = random.Random(n_passage)
    passages = [prose(rnd, n_passage) for _ in range(12)]
    docs = [(0, "\n".join([prose(rnd, n_other // 2), p, prose(rnd, n_other - n_other // 2)])) for p in passages for _ in range(n_docs)]
    out = tp.dedupe_lines(spark, spark.createDataFrame([(k, t) for k, (_, t) in enumerate(docs)], "doc_id long, text string")).collect()
    assert all(r.n_dropped == 1 and not any(p in r.text for p in passages) for r in out)


def test_passage_beside_large_copy_groups(spark):
    rnd = random.Random(8)
    passage = prose(rnd, 60)
    docs = [f"{prose(rnd, 60)}\n{passage}\n{prose(rnd, 60)}" for _ in range(20)]
    copies = ["\n".join([prose(rnd, 30), passage, *(prose(rnd, 20) for _ in range(8))])] * 200
    # Near copies: a word of another line differs.
    lines = [prose(rnd, 25) for _ in range(8)]
    near = ["\n".join([*lines[:3], lines[3] + " " + prose(rnd, 1), *lines[4:]]) for _ in range(200)]
    out = tp.dedupe_lines(spark, spark.createDataFrame(list(enumerate(docs + copies + near)), "doc_id long, text string")).collect()
    assert all(r.n_dropped == (r.doc_id < 220) for r in out)


def test_large_leaves_keep_templates(spark, monkeypatch):
    monkeypatch.setattr(tp, "LEAF_LINES", 8)
    rnd = random.Random(5)
    docs = [f"Posted on Monday by {prose(rnd, 1)} in our news section\n{prose(rnd, 40)}\nPosted on Monday {prose(rnd, 6)}" for _ in range(150)]
    out = tp.dedupe_lines(spark, spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert all(r.n_dropped == 1 and "in our news section" not in r.text for r in out)


def test_merge_compares_all_templates_that_can_fit():
    rnd = np.random.default_rng(3)
    for size in range(3, 16):
        lines = [rnd.integers(1, 4, size).astype(np.int32) for _ in range(300)]
        form, want = [], []
        for line in lines:
            same = [(f == line).mean() for f in form]
            if form and max(same) >= tp.AGREE:
                best = int(np.argmax(same))
                form[best] = np.where(form[best] == line, line, -1)
            else:
                best = len(form)
                form.append(line.copy())
            want.append(best)
        assert tp.merge_templates(lines) == want


def test_merge_where_an_opening_is_common():
    rnd = np.random.default_rng(8)
    lines = np.concatenate([np.tile([7, 7, 7, 7, 7, 7], (3000, 1)), rnd.integers(1, 60, (3000, 14))], axis=1)
    lines[rnd.random(lines.shape) < 0.03] = -1
    copies = lines[rnd.integers(0, 3000, 800)]
    for line in copies:
        line[rnd.integers(0, 20, 3)] = rnd.integers(1, 60, 3)
    lines = list(np.concatenate([lines, copies]))
    form, want = np.empty((0, 20), np.int64), []
    for line in lines:
        same = ((form == line) & (line >= 0)).mean(1) if len(form) else np.zeros(1)
        best = int(same.argmax()) if same.max() >= tp.AGREE else len(form)
        form = np.concatenate([form, line[None]]) if best == len(form) else form
        form[best][form[best] != line] = -1
        want.append(best)
    found, forms = tp.merged(lines)
    assert found == want and (forms == form).all() and len(form) < 3700


def test_a_hundred_thousand_lines_with_one_opening():
    rnd = np.random.default_rng(9)
    lines = np.concatenate([np.tile([1, 2, 3, 4, 5, 6], (100_000, 1)), rnd.integers(1, 10**6, (100_000, 10))], axis=1)
    start = time.process_time()
    assert len(set(tp.merge_templates(list(lines)))) == 100_000
    assert time.process_time() - start < 30


def brute_templates(items):
    """The template (a number) of each item (leaf, order, words), merged in order within each leaf."""
    forms, out = {}, {}
    for leaf, _, words in sorted(items, key=lambda x: (str(x[0]), x[1])):
        known = forms.setdefault(leaf, [])
        same = [sum(a == b for a, b in zip(f, words, strict=True)) / len(words) for f in known]
        if known and max(same) >= tp.AGREE:
            best = same.index(max(same))
            known[best] = [a if a == b else None for a, b in zip(known[best], words, strict=True)]
        else:
            best = len(known)
            known.append(list(words))
        out[leaf, tuple(words)] = (leaf, best)
    return out


def test_recurring_lines_match_a_brute_force_tree(spark):
    rnd = random.Random(12)
    vocabulary = [prose(rnd, 1) for _ in range(9)]
    docs = []
    for _ in range(120):
        lines = [" ".join(["on", "this", "day", *(rnd.choice(vocabulary) for _ in range(rnd.choice([5, 6, 9])))]) for _ in range(4)]
        docs.append("\n".join([*lines, prose(rnd, 70), f"page {rnd.randrange(99)} of {rnd.randrange(99)} in all"]))
    masked = lambda line: tuple("#" if re.search(r"\d", v) else v for v in ws(line))
    hashed = {}
    for text in docs:
        x = tp.Lines(*text_bytes(pa.array([text], pa.string())))
        for line, h in zip(text.split("\n"), x.line.view(np.int64).tolist(), strict=True):
            hashed[masked(line)] = h
    name = brute_templates([((len(w), w[:3]), h, w) for w, h in hashed.items()])
    holders = {}
    for k, text in enumerate(docs):
        for line in text.split("\n"):
            w = masked(line)
            holders.setdefault(name[(len(w), w[:3]), w], set()).add(k)
    want = {h for w, h in hashed.items() if len(holders[name[(len(w), w[:3]), w]]) >= tp.MIN_DOCS}
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    assert {r.line for r in tp.recurring_lines(spark, df).collect()} == want and len(want) < len(hashed)


def test_leaf_left_over_is_merged_by_parts(spark, monkeypatch):
    monkeypatch.setattr(tp, "LEAF_LINES", 5)
    rnd = random.Random(4)
    # Lines that no round lessens by a fifth, and among them one template of few lines.
    lines = [f"here it is {prose(rnd, 12)}" for _ in range(60)]
    base = ws(prose(rnd, 12))
    for k in range(6):
        base[k] = prose(rnd, 1)
        lines.append("here it is " + " ".join(base[:k] + [prose(rnd, 1)] + base[k + 1 :]))
    docs = [f"{line}\n{prose(rnd, 40)}" for line in lines]
    x = [tp.Lines(*text_bytes(pa.array([v], pa.string()))) for v in lines]
    rows = [(7, int(v.line.view(np.int64)[0]), np.maximum(v.masked >> np.uint64(1), np.uint64(1)).tobytes()) for v in x]
    named = {r.line: r.template for r in tp.parsed_lines(spark, spark.createDataFrame(rows, "leaf long, line long, codes binary")).collect()}
    assert len(named) == 66 and len({named[h] for _, h, _ in rows[:60]}) == 60 and len({named[h] for _, h, _ in rows[60:]}) < 4
    assert len(docs) == 66


def test_rows_of_numbers_stay(spark):
    rnd = random.Random(8)
    number = lambda: rnd.choice([f"{rnd.randrange(10**6)}", f"2{rnd.randrange(10**3):03}-0{rnd.randrange(1, 9)}-11", f"{rnd.random():.4f}"])
    table = lambda k: "\n".join([prose(rnd, 9), *(" ".join(number() for _ in range(6)) for _ in range(3)), f"total {number()} {number()} {number()}", f"seen by user{rnd.randrange(999)} at 1{k % 9}:00"])
    docs = [(k, table(k)) for k in range(60)]
    out = {r.doc_id: r.text for r in tp.dedupe_lines(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(out[k] == t.rpartition("\n")[0] for k, t in docs)


@pytest.mark.parametrize("sent", [1 << 21, -1])
def test_columns_of_any_name_are_kept(spark, monkeypatch, sent):
    monkeypatch.setattr(tp, "MOST_SENT", sent)
    names = ("key", "line", "at", "drop", "__drop", "__key", "n_dropped")
    rows = [(i, t, *(f"{c}{i}" for c in names)) for i, t in made() if i < 100]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names)).repartition(3)
    count = tp.free_name("n_dropped", docs.columns)
    out = tp.dedupe_lines(spark, docs, count)
    assert out.columns == [*docs.columns, "n_dropped_"] and tp.free_name("N", ["n", "n_"]) == "N__"
    found = out.collect()
    assert all(r[c] == f"{c}{r.doc_id}" for r in found for c in names) and sum(r[count] for r in found) > 40


def test_outlines_hash_only_what_is_asked():
    texts = ["a b c d\nx 12 yy z 9\n\n  one two", None, "", "Item 7 of the list: 55 pieces\n1 2 3 4\nab 1\n" * 3, "word " * 400 + "\nlast 1 line here"]
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    x, y = tp.Outline(data, offsets), tp.Lines(data, offsets)
    assert x.leaf.tolist() == y.leaf.tolist() and len(set(y.line.tolist())) > 4
    which = np.arange(0, len(y.line), 2)
    assert x.lines_at(which).tolist() == y.line[which].tolist()
    assert not hasattr(x, "masked")
