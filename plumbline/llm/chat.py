r"""Relational chat formatting, with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role are merged into one block; blocks
are concatenated under this template:

    <|turn|>role<|text|>text<|part|>text<|end|>\n ...

Every control string begins with `<|`. Texts and roles have `\` doubled and then `<|` written `<\|`, so no control string
can stand inside them, and the original reads back exactly. The loss mask is a list of [start, stop) code point spans of the
formatted string, one for each assistant text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let

TURN, TEXT, PART, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>\n"
LOSS_ROLE = "assistant"


def escape(column: Column) -> Column:
    return F.replace(F.replace(column, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(column: Column) -> Column:
    return F.replace(F.replace(column, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, formatted, loss_spans array<struct<start, stop>>) for each conversation.

    Null roles and texts count as empty; rows without a conversation id form one of their own; turns that tie are ordered by
    role, then text; repeated rows all stay. A conversation is one output row, so its turns must fit a task; the prefix sums
    of its spans take time quadratic in its number of blocks. Other columns are not read.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), escape(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    chats = turns.groupBy(F.col(conv_col).alias("__conv")).agg(F.sort_array(F.collect_list(turn)).alias("__turns"))

    def blocks(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (F.get(t, i - 1)["role"] != F.get(t, i - 2)["role"]))
        return let(starts, lambda s: F.transform(s, lambda at, j: F.struct(
            F.get(t, at - 1)["role"].alias("role"),
            F.transform(F.slice(t, at, F.coalesce(F.get(s, j + 1), F.size(t) + 1) - at), lambda x: x["text"]).alias("texts"),
        )))

    def rendered(b: Column) -> Column:
        return F.concat(F.lit(TURN), escape(b["role"]), F.lit(TEXT), F.array_join(b["texts"], PART), F.lit(END))

    def spans(all_blocks: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

        def text_spans(first: Column, texts: Column) -> Column:
            lengths = F.transform(texts, lambda x: F.length(x))
            start = F.struct(first.alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))
            return F.aggregate(lengths, start, lambda a, n: F.struct((a["at"] + n + len(PART)).alias("at"), F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), (a["at"] + n).alias("stop")))).alias("spans")))["spans"]

        def step(a: Column, b: Column) -> Column:
            first = a["at"] + len(TURN) + F.length(escape(b["role"])) + len(TEXT)
            own = F.when(b["role"] == LOSS_ROLE, text_spans(first, b["texts"])).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))
            return F.struct((a["at"] + F.length(rendered(b))).alias("at"), F.concat(a["spans"], own).alias("spans"))

        return F.aggregate(all_blocks, zero, step)["spans"]

    merged = chats.select("__conv", blocks(F.col("__turns")).alias("__blocks"))
    return merged.select(F.col("__conv").alias(conv_col), F.array_join(F.transform("__blocks", rendered), "").alias("formatted"), spans(F.col("__blocks")).alias("loss_spans"))


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_col, turns array<struct<role, text>>, loss array<string>, formatted): what the formatted strings and masks say."""
    chunks = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda x: x != "")

    def parsed(block: Column) -> Column:
        head = F.substring_index(block, TEXT, 1)
        body = F.substr(block, F.length(head) + len(TEXT) + 1)
        role = unescape(F.substr(head, F.lit(len(TURN) + 1)))
        return F.transform(F.split(body, r"<\|part\|>"), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"])))
    return formatted.select(conv_col, F.flatten(F.transform(chunks, parsed)).alias("turns"), loss.alias("loss"), "formatted")


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    back = read_back(formatted, conv_col)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        conv_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts imitate another template's control strings."""
    probe = spark.sql("SELECT -1L AS conv_id, stack(2, 0L, 'user', 1L, 'assistant') AS (turn, role)").withColumn("text", F.lit("</s>[INST] ok [/INST]"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(probe)
    return digests(format_chats(rows))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS opens,
         length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS n, length(replace(replace(role, '\', '\\'), '<|', '<\|')) AS r FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(n) + sum(CASE WHEN opens THEN 8 + r + 8 + 8 ELSE 8 END))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
