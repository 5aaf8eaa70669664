"""Chat formatting with budgeted windows, in DataFrame functions only.

A turn becomes `<|start|>role<|text|>text<|end|>`.  Control strings inside
roles and texts are broken by a backslash after their first character and
backslashes are doubled, so `unescaped(escaped(x)) == x` for every x.

Per conversation, prefix sums of turn tokens, from a window over its turns, cut turn-aligned spans: a window
ends before the turn that would take it over the budget left beside the system
turn and the history allowance; a longer turn stands alone, whole.  Later
windows open with the system turn and up to `history_turns` turns just before
the span (at most `history_tokens` tokens).  Only assistant texts of the span
itself are targets; repeated ones are masked.

Nulls and odd rows: a null text or role is empty; null conv_ids form one
conversation; turns tied on number go by role, then text; repeated rows are
repeated turns.  An empty table gives no windows.  Other columns are ignored.
A conversation is the unit of the format, so one task holds its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import n_words, table

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
#: What may follow the first character of a control string that tokenizers know.
CONTROL = r"([<\[])(?=\||/?s>|unk>|pad>|</?SYS>>|/?INST\])"
MARKER_TOKENS = 3
BUDGET = 512
HISTORY_TURNS = 2
HISTORY_TOKENS = 128


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chat_windows(turns: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """(conv_id, window, context_turns, n_turns, n_tokens, formatted, loss_spans) of each window.

    loss_spans are (start, length) in code points of `formatted`.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(START), escaped(role), F.lit(TEXT))
    said = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), head.alias("head"), escaped(text).alias("body"), (n_words(text) + MARKER_TOKENS).alias("tokens"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    said = said.withColumns({"at": F.row_number().over(order), "until": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    turn = F.struct("at", "role", "text", "head", "body", "tokens", "until")
    convs = said.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    sums = F.concat(F.array(F.lit(0).cast("long")), F.transform("turns", lambda t: t["until"]))
    system = F.array_position(F.transform("turns", lambda t: t["role"]), "system").cast("int") - 1
    convs = convs.withColumns({"sums": sums, "sys": system})
    sys_tokens = F.when(F.col("sys") >= 0, F.get("turns", F.col("sys"))["tokens"]).otherwise(0)
    convs = convs.withColumn("room", F.greatest(F.lit(1).cast("long"), F.lit(budget) - F.lit(history_tokens) - sys_tokens))
    # The starts of the windows: i opens one when the words up to its end pass the room from the last start on.
    indices = F.sequence(F.lit(1), F.size("turns") - 1)
    starts = F.when(F.size("turns") < 2, F.array(F.lit(0))).otherwise(
        F.aggregate(indices, F.array(F.lit(0)), lambda acc, i: F.when(F.get("sums", i + 1) - F.get("sums", F.element_at(acc, -1)) > F.col("room"), F.concat(acc, F.array(i))).otherwise(acc))
    )
    convs = convs.withColumn("starts", starts)

    def window(s: Column, k: Column) -> Column:
        until = F.coalesce(F.get("starts", k + 1), F.size("turns"))
        first = F.greatest(F.col("sys") + 1, s - F.lit(history_turns), F.lit(0))
        back = F.when(first < s, F.sequence(first, s - 1)).otherwise(F.array().cast("array<int>"))
        back = F.filter(back, lambda i: F.get("sums", s) - F.get("sums", i) <= history_tokens)
        again = F.when((F.col("sys") >= 0) & (F.col("sys") < s), F.array(F.col("sys"))).otherwise(F.array().cast("array<int>"))
        pick = lambda at: F.transform(at, lambda i: F.get("turns", i))
        return F.struct(k.alias("window"), pick(F.concat(again, back)).alias("context"), F.slice("turns", s + 1, until - s).alias("own"))

    rows = convs.select("conv_id", F.explode(F.transform("starts", window)).alias("w")).select("conv_id", "w.*")
    part = lambda loss: lambda t: F.struct(t["head"].alias("head"), t["body"].alias("body"), (loss & (t["role"] == "assistant")).alias("loss"), t["tokens"].alias("tokens"))
    rows = rows.withColumn("parts", F.concat(F.transform("context", part(F.lit(False))), F.transform("own", part(F.lit(True)))))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + len(END)
    span = lambda acc, p: F.array(F.struct((acc["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length")))
    spans = F.aggregate("parts", empty, lambda acc, p: F.struct((acc["at"] + size(p)).alias("at"), F.when(p["loss"], F.concat(acc["spans"], span(acc, p))).otherwise(acc["spans"]).alias("spans")))
    return rows.select(
        "conv_id", "window", F.size("context").alias("context_turns"), F.size("own").alias("n_turns"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda acc, p: acc + p["tokens"]).alias("n_tokens"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        spans["spans"].alias("loss_spans"),
    )


def parsed_turns(formatted: Column) -> Column:
    """Array of (role, text), read back from a window."""
    pieces = F.slice(F.split(formatted, r"<\|start\|>"), 2, 1 << 30)
    return F.transform(pieces, lambda p: F.struct(unescaped(F.substring_index(p, TEXT, 1)).alias("role"), unescaped(F.substring_index(F.substring_index(p, END, 1), TEXT, -1)).alias("text")))


def conversation_digest(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation say, read back from their text and loss spans."""
    own = F.slice(parsed_turns(F.col("formatted")), F.col("context_turns") + 1, 1 << 30)
    loss = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    rows = windows.select("conv_id", "window", own.alias("own"), F.array_join(loss, "").alias("loss"), F.length("formatted").cast("long").alias("chars"))
    said = F.array_join(F.transform("own", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = rows.select("conv_id", "chars", F.size("own").cast("long").alias("n"), F.struct("window", said.alias("said"), "loss").alias("w"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    whole = whole.withColumns({"said": F.array_join(F.col("w.said"), ""), "loss": F.array_join(F.col("w.loss"), "")})
    return whole.select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    kinds = dict(turns.dtypes)
    added = added.select(*[F.col(c).cast(kinds[c]).alias(c) for c in turns.columns])
    return conversation_digest(chat_windows(turns.unionByName(added)))
