"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example: all turns before it are context, the reply alone is trainable.
A row holds the formatted turns since the example before it, and ahead of them the whole context, however long the conversation is. Contexts of a
conversation grow with the square of its turns. A caller who can't hold them may state limits; rows of conversations beyond these come without context and say
how many characters and turns of the conversation's earlier rows stand before them, and ``expand`` writes the contexts out.

Template of a turn: ``<|turn|>`` role, newline, text, ``<|end|>``. Inside texts each control string of this
and of other common templates gets a backslash after its first character (one more if it has some already),
which ``unescape`` takes away again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: What may follow the first character of a control string; fixed values.
_TAILS = r"(?=\||/?s>|/?INST\]|</?SYS>>)"
CHUNK_TURNS = 256
#: Limits for callers who don't want the contexts of long conversations: turns and formatted characters. Nothing here sets them by itself.
WHOLE_TURNS, WHOLE_CHARS = 64, 200_000


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAILS, "$1\\\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAILS, "$1$2")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    plain = F.replace(unescape(role), F.lit("\\\\"), F.lit("\0"))
    return F.replace(F.replace(plain, F.lit("\\n"), F.lit("\n")), F.lit("\0"), F.lit("\\"))


def _conv(a: DataFrame, b: DataFrame, *more: str) -> Column:
    on = a["conv_id"].eqNullSafe(b["conv_id"])
    for name in more:
        on = on & a[name].eqNullSafe(b[name])
    return on


def prefix_examples(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    target_role: str = "assistant",
    whole_turns: int | None = None,
    whole_chars: int | None = None,
) -> DataFrame:
    """(conv_id, example, context, context_chars, context_turns, segment, segment_turns, loss_start, loss_length).

    An example's text is ``context`` and ``segment``; only where a limit is given is the context null in conversations of more than ``whole_turns`` turns or
    ``whole_chars`` characters; it is the segments of the rows before. One row per turn of ``target_role``, numbered from 0 in each conversation, and one without loss for turns
    after the last of these. ``segment`` holds the formatted turns since the row before; loss_start (from 0)
    and loss_length mark the escaped reply inside it (null without one). Null roles and texts count as
    empty; null conversations form one conversation; null turns come first; equal turns go by role, then
    text. An empty table gives an empty result; further columns are not read.

    A conversation of any length is numbered in chunks of turns by their numbers, so a task sorts no more than the turns of CHUNK_TURNS
    numbers; turns without a number, and those that repeat one, are in one chunk.
    """
    own = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    body = escape(F.col("text"))
    own = own.select(
        "conv_id",
        "turn",
        F.floor(F.col("turn") / CHUNK_TURNS).alias("chunk"),
        "role",
        "text",
        F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n"), body, F.lit(END)).alias("piece"),
        F.length(body).cast("long").alias("body_chars"),
        (F.col("role") == target_role).cast("long").alias("reply"),
    ).withColumn("chars", F.length("piece").cast("long"))
    sums = own.groupBy("conv_id", "chunk").agg(
        F.sum("reply").alias("replies"), F.sum("chars").alias("all_chars"), F.count("*").alias("all_turns")
    )
    earlier = Window.partitionBy("conv_id").orderBy(F.col("chunk").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("conv_id")
    whole = F.lit(True)
    for name, limit in (("all_turns", whole_turns), ("all_chars", whole_chars)):
        whole = whole if limit is None else whole & (F.sum(name).over(every) <= limit)
    sums = sums.select(
        "conv_id",
        "chunk",
        *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_0") for c in ("replies", "all_chars", "all_turns")),
        whole.alias("whole"),
    )
    inside = (
        Window.partitionBy("conv_id", "chunk")
        .orderBy(F.col("turn").asc_nulls_first(), "role", "text")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = own.select(
        "*",
        F.coalesce(F.sum("reply").over(inside), F.lit(0)).alias("in_replies"),
        F.coalesce(F.sum("chars").over(inside), F.lit(0)).alias("in_chars"),
        F.coalesce(F.count(F.lit(1)).over(inside), F.lit(0)).alias("in_turns"),
    )
    numbered = placed.join(sums, _conv(placed, sums, "chunk")).select(
        placed["conv_id"],
        (F.col("in_replies") + F.col("replies_0")).alias("example"),
        (F.col("in_chars") + F.col("all_chars_0")).alias("at_char"),
        (F.col("in_turns") + F.col("all_turns_0")).alias("at_turn"),
        "piece",
        "reply",
        "body_chars",
        "whole",
    )
    ordered = F.array_sort(F.collect_list(F.struct("at_turn", "piece")))
    made = numbered.groupBy("conv_id", "example").agg(
        F.min("at_char").alias("context_chars"),
        F.min("at_turn").alias("context_turns"),
        F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("segment"),
        F.count("*").alias("segment_turns"),
        F.sum(F.when(F.col("reply") == 1, F.col("body_chars"))).alias("loss_length"),
        F.first("whole").alias("whole"),
    )
    # rows of large conversations are alone in their windows
    before = Window.partitionBy("conv_id", F.when(F.col("whole"), F.lit(-1)).otherwise(F.col("example"))).orderBy("example")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    made = made.withColumn("context", F.when(F.col("whole"), F.array_join(F.collect_list(F.when(F.col("whole"), F.col("segment"))).over(before), "")))
    start = F.length("segment") - F.lit(len(END)) - F.col("loss_length")
    return made.select(
        "conv_id", "example", "context", "context_chars", "context_turns", "segment", "segment_turns", start.alias("loss_start"), "loss_length"
    )


def expand(examples: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_length): each example with its whole context written out.

    The result grows with the square of a conversation's turns; that is what whole contexts are.
    """
    upto = Window.partitionBy("conv_id").orderBy("example").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return examples.select("*", F.array_join(F.collect_list("segment").over(upto), "").alias("__text")).filter("loss_length is not null").select(
        "conv_id", "example", F.col("__text").alias("text"), (F.col("context_chars") + F.col("loss_start")).alias("loss_start"), "loss_length"
    )


def read_back(examples: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role,text>>, losses array<string>, formatted_chars) from formatted examples alone.

    Where examples carry their contexts, each reply is read from its own example and the turns from the last one. Gathered in two steps,
    so that a task of the second reads one row per ``CHUNK_TURNS`` examples.
    """
    whole = F.concat("context", "segment")  # null without a context
    text, at = F.coalesce(whole, F.col("segment")), F.col("loss_start") + F.when(F.col("context").isNull(), 0).otherwise(F.col("context_chars"))
    loss = F.when(F.col("loss_length").isNotNull(), unescape(F.substr(text, (at + 1).cast("int"), F.col("loss_length").cast("int"))))
    parts = examples.select(
        "conv_id",
        "example",
        F.floor(F.col("example") / CHUNK_TURNS).alias("chunk"),
        F.when(F.col("context").isNull(), F.col("segment")).alias("segment"),
        loss.alias("loss"),
        whole.alias("text"),
    )
    first = parts.groupBy("conv_id", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("example", "segment", "loss"))).alias("xs"), F.max_by("text", "example").alias("text")
    )
    merged = first.groupBy("conv_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "xs"))), lambda c: c["xs"])).alias("xs"), F.max_by("text", "chunk").alias("last")
    )
    text = F.coalesce("last", F.array_join(F.transform("xs", lambda x: x["segment"]), ""))

    def turn(piece: Column) -> Column:
        rest = F.substr(piece, F.lit(len(TURN) + 1))
        role = F.substring_index(rest, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(rest, F.length(role) + 2)).alias("text"))

    pieces = F.filter(F.split("text", r"<\|end\|>"), lambda x: x != "")
    return merged.select("conv_id", "xs", text.alias("text")).select(
        "conv_id",
        F.transform(pieces, turn).alias("turns"),
        F.filter(F.transform("xs", lambda x: x["loss"]), lambda x: x.isNotNull()).alias("losses"),
        F.length("text").cast("long").alias("formatted_chars"),
    )
