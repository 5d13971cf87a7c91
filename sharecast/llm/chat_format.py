"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one training example: all turns before it are the
context, and only the reply is trainable. A turn is written as

    <|im_start|>role\\ntext<|im_end|>\\n

Control strings inside texts are escaped reversibly: a ``<`` followed by any
number of backslashes and ``|`` gets one more backslash, so an escaped text never
holds ``<|`` and the turn marks stay unambiguous. Roles are percent-escaped
(``%``, ``<`` and line feed), so a role never ends its own line early.

Defined cases: a null role or text is empty; turns are ordered by (turn, role,
text) with nulls first, so repeated turn numbers and repeated rows all stay, in a
fixed order; rows with a null conversation id form one conversation; turns after
the last assistant turn (or a conversation without one) come out as one closing
row that has no target; an empty table gives no rows; other input columns are
ignored. An example holds all its preceding turns, so one conversation must fit
in a row; that, not the number of conversations, is what a task holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, pick, sha256_hex

START, END = "<|im_start|>", "<|im_end|>\n"


def escape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    for raw, code in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape_role(c: Column) -> Column:
    for raw, code in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def prefix_target_examples(conversations: DataFrame, *, conv_col: str = "conv_id",
                           turn_col: str = "turn", role_col: str = "role",
                           text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """One row per assistant turn (and a closing row, see the module text).

    Returns ``conv_id``, ``position`` (0-based place of the example's last turn),
    ``text`` (context and reply, formatted), ``loss_start`` and ``loss_chars`` (the
    trainable span of ``text`` in code points; 0 characters and null start in a
    closing row) and ``is_target``."""
    c = pick(conversations, [conv_col, turn_col, role_col, text_col]).toDF(
        "conv_id", "turn", "role", "text")
    turns = (c.select("conv_id", F.struct(
                "turn", F.coalesce("role", F.lit("")).alias("role"),
                F.coalesce("text", F.lit("")).alias("text")).alias("t"))
             .groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")))
    parts = turns.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(
            t["role"].eqNullSafe(F.lit(target_role)).alias("is_target"),
            F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"),
            escape_text(t["text"]).alias("body"))).alias("parts"))
    ends = F.filter(F.sequence(F.lit(0), F.size("parts") - 1),
                    lambda i: F.get("parts", i)["is_target"] | (i == F.size("parts") - 1))
    at = parts.select("conv_id", "parts", F.explode(ends).alias("position"))
    last = F.get("parts", F.col("position"))
    spread = at.select(
        "conv_id", "position",
        F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("position")),
                                 lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
        .alias("context"),
        last["head"].alias("head"), last["body"].alias("body"), last["is_target"].alias("is_target"))
    return spread.select(
        "conv_id", "position",
        F.concat("context", "head", "body", F.lit(END)).alias("text"),
        F.when(F.col("is_target"), F.length("context") + F.length("head")).alias("loss_start"),
        F.when(F.col("is_target"), F.length("body")).otherwise(0).alias("loss_chars"),
        "is_target")


def read_turns(text: Column) -> Column:
    """The (role, text) pairs of a formatted example, unescaped."""
    marks = F.split(text, r"<\|im_end\|>\n", -1)
    return let(marks, lambda m: F.transform(
        F.slice(m, F.lit(1), F.size(m) - 1),
        lambda s: let(F.substring(s, len(START) + 1, 2147483647), lambda b: F.struct(
            unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
            unescape_text(F.substr(b, F.instr(b, "\n") + 1)).alias("text")))))


def conversation_digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted examples: turn count and
    digest of all turns (from the longest example), digest of what the loss masks
    of all examples cover, and the characters written."""
    e = examples.select(
        "conv_id", "position", "text",
        F.when(F.col("is_target"), F.struct("position", unescape_text(
            F.substr("text", F.col("loss_start") + 1, F.col("loss_chars"))).alias("reply"))).alias("loss"))
    per = e.groupBy("conv_id").agg(
        F.max_by("text", "position").alias("text"),
        F.array_join(F.transform(F.array_sort(F.collect_list("loss")), lambda x: x["reply"]), "")
        .alias("loss"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"))
    read = per.select("conv_id", "loss", "formatted_chars", read_turns(F.col("text")).alias("turns"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        sha256_hex(F.array_join(F.transform("turns", lambda t: F.concat(
            t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        sha256_hex(F.col("loss")).alias("loss_sha256"), "formatted_chars")
