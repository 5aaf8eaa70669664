import base64
import hashlib
import re
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, mixing, warc
from tessera.llm.textkit import word_counts

TURNS = "conv_id long, turn int, role string, text string"


def test_escape_round_trip(spark):
    texts = ["", "\\", "\\\\n", "<|start|>", "</s>[INST] ok [/INST]", "<<SYS>>x<</SYS>>", "a\\<|b", "$1 \\$", "<", "[", "\n\\\n", "é<|é"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("back")).collect()
    for r in rows:
        assert r.back == r.t
        assert not re.search(r"<\||</?s>|\[/?INST\]|<<SYS>>", r.e)


def expected_chat(rows):
    convs = defaultdict(list)
    for c, n, role, text in rows:
        convs[c].append((n, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_reads_back_whole(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r[1:5]) for r in chat.op5_chat(spark, sf_dir).collect()}
    tricky = "</s>[INST] ok [/INST]"
    assert got == expected_chat([*rows, (-1, 0, "user", tricky), (-1, 1, "assistant", tricky)])


def test_chat_windows_bounds_and_odd_rows(spark):
    rows = [(1, 0, "system", "be kind"), *[(1, k, "user" if k % 2 else "assistant", "w " * 30) for k in range(1, 40)], (2, 0, None, None), (2, 1, "assistant", None), (3, 5, "assistant", "x " * 900), (3, 5, "assistant", "x " * 900), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, TURNS).withColumn("formatted", F.lit("clash"))
    windows = chat.chat_windows(df, budget=200, history_turns=2, history_tokens=80)
    out = windows.collect()
    assert all(w.n_tokens <= 200 or w.n_turns == 1 for w in out)
    later = [w for w in out if w.conv_id == 1 and w.window > 0]
    assert later and all(w.formatted.startswith("<|start|>system<|text|>be kind") and w.context_turns == 3 for w in later)
    got = {r[0]: tuple(r[1:5]) for r in chat.conversation_digest(windows).collect()}
    assert got == expected_chat(rows)
    assert chat.conversation_digest(chat.chat_windows(spark.createDataFrame([], TURNS))).count() == 0


def brute_targets(sizes):
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    left, target, free = 1.5 * sum(sizes.values()), {}, list(sources)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 3, None: 50, "": 0, "é": 7}, {"a": 5}, {"a": 0}])
def test_targets_match_water_filling(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix_copies(spark):
    rows = [(k, "w " * (k % 50 + 1), "abc"[k % 3] if k % 7 else None, 1) for k in range(3000)] + [(None, None, "a", 1), (5, "w", "a", 1), (5, "w", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies long")
    plan = mixing.digest(docs).collect()
    assert len(plan) == len(rows) and sorted(map(str, plan)) == sorted(map(str, mixing.digest(docs.repartition(3)).collect()))
    taken, target = defaultdict(int), {}
    for r in plan:
        assert r.taken <= 2 * r.size
        taken[r.target] += r.taken
    assert all(abs(v - t) < 0.06 * t for t, v in taken.items() if t > 10000)
    assert mixing.mix(docs).count() == sum(r.copies for r in mixing.mixing_plan(docs).collect())
    assert mixing.digest(docs.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = ["<p>é</p>", None, "", fake, f"x\r\n\r\n{fake}y", "\r\n\r\n" + fake * 3, "same", "same", "same", "WARC/1.0\r\n\r\n\r\n"] + [f"page {k}" * k for k in range(60)]
    rows = [(k, f"http://a/{k}\r\nX", h, "x") for k, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").coalesce(2)
    warc.write_warc(pages, f"file://{tmp_path}/w")
    got = {r.page_id: tuple(r)[1:] for r in warc.digest(spark, warc.read_warc(spark, f"file://{tmp_path}/w", payload=False)).collect()}
    last = {h or "": k for k, h in enumerate(html)}
    assert len(got) == len(rows)
    for k, h in enumerate(html):
        raw, kept = (h or "").encode(), last[h or ""]
        assert got[k] == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if kept == k else "revisit", None if kept == k else kept)
    texts = {r.record_id: bytes(r.payload) for r in warc.read_warc(spark, f"file://{tmp_path}/w").where("type = 'response'").collect()}
    assert texts["<urn:page:4>"].decode() == html[4] and len(texts) == len(last)


def test_warc_empty_and_null_ids(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/e")
    assert warc.read_warc(spark, f"file://{tmp_path}/e").count() == 0
    odd = spark.createDataFrame([(None, None, "a"), (3, "u", "a"), (3, "u", "a")], "page_id long, url string, html string")
    warc.write_warc(odd, f"file://{tmp_path}/o")
    got = sorted((r.page_id is None, r.record_type) for r in warc.digest(spark, warc.read_warc(spark, f"file://{tmp_path}/o")).collect())
    assert got == [(False, "response"), (False, "response"), (True, "response")]


def test_warc_pages_of_one_id(spark, tmp_path):
    rows = [(5, "a" * 30), (5, "b" * 40), (3, "a" * 30), (2, "b" * 40), (1, "b" * 40), (5, "c")]
    pages = spark.createDataFrame([(k, "u", h) for k, h in rows], "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/r")
    got = sorted(tuple(r) for r in warc.digest(spark, warc.read_warc(spark, f"file://{tmp_path}/r", payload=False)).collect() if r.record_type == "revisit")
    sha = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    assert got == [(k, len(h), sha(h), "revisit", 5) for k, h in sorted(rows) if k < 5]


def test_word_counts():
    texts = ["a b", None, "", " \n ", "x", "\x1fé\xa0ü \x0b1\t2", "a\x85b  c ", "end", "end"]
    assert word_counts(pa.array(texts)).to_pylist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert word_counts(pa.array([], pa.string())).to_pylist() == []
