"""Chat formatting: every assistant turn becomes its own example, with all turns before it as context.

A turn is OPEN role MIDDLE text CLOSE. Three characters are escaped inside roles and texts, so that no control string
(those of this template, or [INST], </s> and the like) can arise from a text: backslash, < and [ become a backslash and
e, l or b. unescape() turns that back exactly. Only the reply is trainable: loss_start and loss_chars give its span in
code points of the formatted example.

Order is by turn, then role, then text; null roles and texts count as empty, null turns come first. Each conversation
also gives one row without a target (target_ix null, loss_chars 0) that holds all its turns, so that turns after the
last reply, and conversations without a reply, are kept as well.

The size of the output is that of the method: a reply's context is repeated for every later reply. A conversation's
turns meet in one row, since an example is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(c: Column) -> Column:
    """Every backslash of an escaped text starts a pair, so the pairs are turned back one kind at a time."""
    return F.replace(F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\e"), F.lit("\\"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> from a formatted string."""
    turns = F.filter(F.split(formatted, "<\\|end\\|>", -1), lambda x: x != "")
    at = lambda x: F.instr(x, MIDDLE)
    return F.transform(
        turns,
        lambda x: F.struct(
            unescape(F.substring(x, F.lit(len(OPEN) + 1), at(x) - F.lit(len(OPEN) + 1))).alias("role"),
            unescape(F.substring(x, at(x) + F.lit(len(MIDDLE)), F.length(x))).alias("text"),
        ),
    )


def prefix_target_examples(turns: DataFrame, trainable: str = "assistant") -> DataFrame:
    """conv_id, target_ix (null: the whole conversation), formatted, loss_start (from 0), loss_chars.

    turns: conv_id, turn, role, text; other columns are ignored.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    parts = F.transform("ts", lambda t: F.struct(F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE)).alias("head"), escape(t["text"]).alias("body"), (t["role"] == trainable).alias("target")))
    talks = talks.select("conv_id", parts.alias("ps"))
    whole = lambda ps: F.array_join(F.transform(ps, lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    replies = F.filter(F.transform("ps", lambda p, i: F.when(p["target"], i)), lambda i: i.isNotNull())
    each = talks.select("conv_id", "ps", F.explode(F.concat(F.transform(replies, lambda i: i.cast("int")), F.array(F.lit(None).cast("int")))).alias("target_ix"))
    context = whole(F.slice("ps", F.lit(1), F.coalesce("target_ix", F.size("ps"))))
    each = each.select("conv_id", "target_ix", context.alias("context"), F.when(F.col("target_ix").isNotNull(), F.get("ps", "target_ix")).alias("p"))
    before = F.concat("context", F.col("p.head"))
    return each.select(
        "conv_id",
        "target_ix",
        F.coalesce(F.concat(before, F.col("p.body"), F.lit(CLOSE)), "context").alias("formatted"),
        F.coalesce(F.length(before), F.length("context")).cast("long").alias("loss_start"),
        F.coalesce(F.length("p.body"), F.lit(0)).cast("long").alias("loss_chars"),
    )


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, what its examples hold, read back from the formatted strings."""
    loss = unescape(F.expr("substring(formatted, cast(loss_start + 1 as int), cast(loss_chars as int))"))
    read = F.when(F.col("target_ix").isNull(), read_turns(F.col("formatted")))
    rows = examples.select("conv_id", F.length("formatted").cast("long").alias("chars"), read.alias("turns"), F.struct(F.col("target_ix").alias("ix"), loss.alias("loss")).alias("part"))
    talks = rows.groupBy("conv_id").agg(
        F.sum("chars").alias("formatted_chars"),
        F.first("turns", ignorenulls=True).alias("turns"),
        F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda x: x["loss"]), "").alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return talks.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
