r"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example: all turns up to it, formatted, with a loss mask over that turn's own text.  Turns
after the last assistant turn (or a conversation without one) make a last example without a mask, so the output holds all
that went in.  A turn is `### role: text</turn>` and a line feed.  Inside texts and roles a backslash is written `\\`, `#`
as `\h`, `<` as `\l`, and in roles `:` as `\c`; so neither mark can occur in a text, and the way back is exact.

Rows of a conversation go by turn, then role, then text; null turns come first; repeated rows are turns of their own.
Null texts and roles are empty.  Rows with a null conv_id form one conversation.  An empty table gives an empty result;
other columns are ignored.  A conversation's examples share its prefix, so their texts grow with the square of its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

END = "</turn>\n"


def escaped(text: Column, role: bool = False) -> Column:
    for plain, coded in (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l"), *([(":", "\\c")] if role else [])):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescaped(text: Column) -> Column:
    """Between pairs of backslashes, each read as one, what a single backslash begins is put back."""

    def back(part: Column) -> Column:
        for plain, coded in (("#", "\\h"), ("<", "\\l"), (":", "\\c")):
            part = F.replace(part, F.lit(coded), F.lit(plain))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), back), "\\")


def format_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns (context and target), text, loss_start (from 0), loss_chars, last (the conversation's last example).

    loss_start is null where no text is to be learned."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.select("conv_id", "turn", "role", "text", F.concat(F.lit("### "), escaped(F.col("role"), role=True), F.lit(": ")).alias("head"), escaped(F.col("text")).alias("body"))
    turns = turns.withColumn("form", F.concat("head", "body", F.lit(END)))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.select(
        "conv_id",
        F.sum(F.char_length("form")).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("end"),
        F.row_number().over(order).alias("n_turns"),
        (F.col("role") == "assistant").alias("target"),
        "form",
        F.char_length("head").alias("head_chars"),
        F.char_length("body").alias("body_chars"),
    )
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("end", "n_turns", "target", "head_chars", "body_chars", "form"))).alias("turns"))
    examples = whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["form"]), "").alias("full"),
        F.size("turns").alias("total"),
        F.explode(F.transform(F.filter("turns", lambda t: t["target"] | (t["n_turns"] == F.size("turns"))), lambda t: F.struct(*(t[c].alias(c) for c in ("end", "n_turns", "target", "head_chars", "body_chars"))))).alias("t"),
    )
    return examples.select(
        "conv_id",
        F.col("t.n_turns").cast("long").alias("n_turns"),
        F.substring("full", F.lit(1), F.col("t.end").cast("int")).alias("text"),
        F.when(F.col("t.target"), F.col("t.end") - len(END) - F.col("t.body_chars")).cast("long").alias("loss_start"),
        F.when(F.col("t.target"), F.col("t.body_chars")).otherwise(0).cast("long").alias("loss_chars"),
        (F.col("t.n_turns") == F.col("total")).alias("last"),
    )


def read_turns(text: Column) -> Column:
    """The turns (role, text) of an example's text."""
    parts = F.filter(F.split(text, END, -1), lambda x: x != "")

    def turn(part: Column) -> Column:
        colon = F.instr(part, ":")
        return F.struct(unescaped(F.substring(part, F.lit(5), colon - 5)).alias("role"), unescaped(F.substring(part, colon + 2, F.char_length(part))).alias("text"))

    return F.transform(parts, turn)


def chat_digest(examples: DataFrame) -> DataFrame:
    """What the examples say of each conversation, read from their texts and masks alone."""
    read = examples.select(
        "conv_id",
        F.when(F.col("last"), F.col("text")).alias("whole"),
        F.when(F.col("loss_start").isNotNull(), F.struct("n_turns", unescaped(F.substring("text", (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int"))).alias("loss"))).alias("loss"),
        F.char_length("text").alias("chars"),
    )
    joined = read.groupBy("conv_id").agg(
        F.max("whole").alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list("loss")), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    turns = joined.select("conv_id", read_turns(F.col("whole")).alias("turns"), "loss", "formatted_chars")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
