"""Chat examples by prefix-target expansion: each assistant turn becomes an example with all turns before it as context.

A turn is written <turn>role<text>text</turn> and a line feed. In roles and texts a backslash becomes \\b and < becomes \\l,
so no control string can occur inside them; undoing \\l, then \\b, gives the original back. Of an example only the target
is trainable. Turns after the last assistant turn are written as one more example without a target, so that the output
holds every conversation whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"
_TURN = r"<turn>([^<]*)<text>([^<]*)</turn>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def chat_examples(turns: DataFrame) -> DataFrame:
    """conv_id, target (index of the trained turn, or null), prompt, reply; the formatted example is prompt || reply.

    turns: conv_id, turn, role, text. Rows go by turn (null first), then role and text; null roles and texts are empty.
    Repeated rows are turns of their own. The reply is the escaped target with its end mark, which is trained too; the
    prompt ends where the target's text begins. A null conv_id is a conversation. Other columns are ignored.
    """
    # A conversation's last example holds all of it in one row, so its turns must fit one task in any form.
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(ordered.alias("_turns"))
    written = F.transform("_turns", lambda x: F.struct(x["role"].alias("role"), F.concat(F.lit("<turn>"), escaped(x["role"]), F.lit("<text>")).alias("head"), F.concat(escaped(x["text"]), F.lit("</turn>\n")).alias("body")))
    grouped = grouped.select("conv_id", written.alias("_turns"))
    last = F.element_at("_turns", -1)["role"]
    targets = F.filter(F.sequence(F.lit(0), F.size("_turns") - 1), lambda i: F.get("_turns", i)["role"] == TRAINED_ROLE)
    targets = F.when(last == TRAINED_ROLE, targets).otherwise(F.concat(targets, F.array(F.lit(None).cast("int"))))
    examples = grouped.select("conv_id", "_turns", F.explode(targets).alias("target"))
    before = F.slice("_turns", 1, F.coalesce("target", F.size("_turns")))
    context = F.array_join(F.transform(before, lambda x: F.concat(x["head"], x["body"])), "")
    prompt = F.concat(context, F.coalesce(F.get("_turns", F.col("target"))["head"], F.lit("")))
    reply = F.coalesce(F.get("_turns", F.col("target"))["body"], F.lit(""))
    return examples.select("conv_id", "target", prompt.alias("prompt"), reply.alias("reply"))


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, turns (role and text of all turns, from the longest example), replies (the trained texts in order), formatted_chars."""
    length = F.length("prompt") + F.length("reply")
    texts = examples.select("conv_id", "target", F.concat("prompt", "reply").alias("whole"), length.cast("long").alias("chars"), F.when(F.col("target").isNotNull(), unescaped(F.expr("substring(reply, 1, length(reply) - 8)"))).alias("trained"))
    grouped = texts.groupBy("conv_id").agg(F.max_by("whole", "chars").alias("whole"), F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", "trained")))).alias("replies"), F.sum("chars").alias("formatted_chars"))
    parts = F.arrays_zip(F.regexp_extract_all("whole", F.lit(_TURN), 1).alias("role"), F.regexp_extract_all("whole", F.lit(_TURN), 2).alias("text"))
    turns = F.transform(parts, lambda x: F.struct(unescaped(x["role"]).alias("role"), unescaped(x["text"]).alias("text")))
    return grouped.select("conv_id", turns.alias("turns"), F.transform("replies", lambda x: x["trained"]).alias("replies"), "formatted_chars")
