r"""Operator 7: chat formatting with Spark expressions only.

Template: ``<|turn|>role<|text|>...<|end|>`` for each run of adjacent turns of
one role; the texts of a run stand in it one after the other, separated by
``<|next|>``. Inside roles and texts a backslash is doubled and ``<|`` becomes
``<\|``, which can be undone and leaves no control string. The loss mask is a
list of (start, length) in characters of the formatted text: the texts of
``assistant``.

Turns are collected and merged in blocks of ``BLOCK`` turn numbers; blocks of a
conversation are then joined, so what is gathered for a long conversation is a
few rows of finished text. A conversation's text is one value by definition.

Edge cases: a null text counts as empty, a null role as the empty role; null
turns sort first; rows of equal turn sort by role, then text; repeated rows are
kept; rows with null conv_id form one conversation; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
BLOCK = 64


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """conv_id, formatted (string), loss_spans (array of start, length)."""
    rows = turns.select(F.col(conv_col), F.floor(F.col(turn_col) / block).alias("block"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    # Ties are ordered by the plain role and text; only then are they escaped.
    escaped = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    blocks = rows.groupBy(conv_col, "block").agg(escaped.alias("turns"))
    order = Window.partitionBy(conv_col).orderBy("block")
    run = "struct<role:string,texts:array<string>>"
    merged = F.aggregate(
        "turns",
        F.array().cast(f"array<{run}>"),
        lambda runs, t: F.when(
            (F.size(runs) > 0) & (F.element_at(runs, -1)["role"] == t["role"]),
            F.concat(
                F.slice(runs, 1, F.size(runs) - 1),
                F.array(F.struct(t["role"].alias("role"), F.concat(F.element_at(runs, -1)["texts"], F.array(t["text"])).alias("texts"))),
            ),
        ).otherwise(F.concat(runs, F.array(F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))))),
    )
    blocks = blocks.select(conv_col, "block", merged.alias("runs"))
    first, last = F.col("runs")[0]["role"], F.element_at("runs", -1)["role"]
    blocks = blocks.withColumn("joins", F.coalesce(F.lag(last).over(order) == first, F.lit(False))).withColumn("goes_on", F.coalesce(F.lead(first).over(order) == last, F.lit(False)))
    n = F.size("runs")
    # Pieces of text in order, each with whether the loss covers it.
    opening = lambda r, i: F.when((i == 0) & F.col("joins"), F.lit(NEXT)).otherwise(F.concat(F.lit(TURN), r["role"], F.lit(TEXT)))
    closing = lambda i: F.when((i == n - 1) & F.col("goes_on"), F.lit("")).otherwise(F.lit(END))
    piece = lambda s, on: F.struct(s.alias("s"), on.alias("on"))
    pieces = F.flatten(
        F.transform(
            "runs",
            lambda r, i: F.concat(
                F.array(piece(opening(r, i), F.lit(False))),
                F.flatten(F.transform(r["texts"], lambda t, k: F.array(piece(F.when(k > 0, F.lit(NEXT)).otherwise(F.lit("")), F.lit(False)), piece(t, r["role"] == "assistant")))),
                F.array(piece(closing(i), F.lit(False))),
            ),
        )
    )
    blocks = blocks.withColumn("pieces", pieces)
    sums = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["s"])).alias("at"),
            F.when(p["on"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), F.length(p["s"]).cast("long").alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    blocks = blocks.select(conv_col, "block", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("text"), sums.alias("sums"))
    before = F.coalesce(F.sum("sums.at").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("before", before).withColumn("spans", F.transform("sums.spans", lambda s: F.struct((s["start"] + F.col("before")).alias("start"), s["length"].alias("length"))))
    joined = blocks.groupBy(conv_col).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("block", F.lit(-(1 << 62))).alias("block"), "text", "spans"))).alias("b"))
    return joined.select(conv_col, F.array_join(F.transform("b", lambda b: b["text"]), "").alias("formatted"), F.flatten(F.transform("b", lambda b: b["spans"])).alias("loss_spans"))


def read_chats(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The turns (array of role, text) that formatted texts hold, and the unescaped text under the loss mask."""
    runs = F.filter(F.split("formatted", r"<\|turn\|>"), lambda r: r != "")
    turns = F.flatten(
        F.transform(
            runs,
            lambda r: F.transform(
                F.split(F.regexp_replace(F.substring(r, F.instr(r, TEXT) + len(TEXT), F.length(r)), r"<\|end\|>$", ""), r"<\|next\|>"),
                lambda t: F.struct(unescape(F.substring_index(r, TEXT, 1)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int")))), "")
    return formatted.select(conv_col, "formatted", turns.alias("turns"), loss.alias("loss"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_chats(format_chats(table))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), runs AS (
    SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) = role, false) AS goes_on FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       sum(CASE WHEN goes_on THEN 8 ELSE 8 + length(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')) + 8 + 7 END
           + length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')))::BIGINT AS formatted_chars
FROM runs GROUP BY conv_id
"""
