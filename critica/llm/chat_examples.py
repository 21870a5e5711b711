r"""Operator 12 [native]: chat formatting by prefix-target expansion.

A turn is formatted as ``<s>[INST] role [/INST]text</s>``.  Every assistant
turn becomes an example of its own: all turns before it as context, then
the turn itself, of which only the text is trainable (``loss_start`` up to
``loss_end``, code points of the example's text).  Turns after the last
assistant turn, or a conversation without any, make one more example
without a trainable part, so that no turn is lost.

Control strings inside roles and texts are escaped: a backslash is
doubled, and a backslash is put after the first character of a control
string (``<s>`` becomes ``<\s>``).  No control string is left then, and a
backslash always stands before the character that it escapes, so
``unescaped`` gives back the original and ``turns_of`` splits an example at
its end marks.

Scale: one aggregation by conversation and one explode, all in the JVM.
An example repeats its context by definition, so formatted text grows with
the square of a conversation's turns; it is made row by row and only the
turns are shuffled.  A conversation has to fit a row, as its last example
does.

Defined results.  Turns are ordered by turn number, then role, then text,
null first; equal rows each count.  Null roles and texts are empty; only
the role ``assistant`` is trained on.  Rows with a null conversation id
are one conversation.  An empty assistant text has an empty trainable
part.  Other columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, HEAD, TAIL = "<s>", "</s>", "[INST]", "[/INST]"
CONTROL = (START, END, HEAD, TAIL)
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    """``text`` without control strings, reversibly."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.when(text.contains("\\"), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def prefix_examples(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                    text_col: str = "text") -> DataFrame:
    """(conv_id, example, n_turns, last, text, loss_start, loss_end) of every example.

    ``last``: it holds all turns of its conversation.  The loss span is
    null where nothing is trained on.
    """
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("_turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("_role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("_turn", "_role", "_text"))).alias("_turns"))
    turns = turns.select(
        "conv_id",
        F.transform("_turns", lambda t: F.concat(F.lit(f"{START}{HEAD} "), escaped(t["_role"]), F.lit(f" {TAIL}"))).alias("_heads"),
        F.transform("_turns", lambda t: escaped(t["_text"])).alias("_bodies"),
        F.transform("_turns", lambda t: t["_role"] == ASSISTANT).alias("_trained"))
    n = F.size("_heads")
    # Examples end at the assistant turns, and at the last turn.
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.get(F.col("_trained"), i - 1) | (i == n))
    parts = F.zip_with("_heads", "_bodies", lambda h, b: F.concat(h, b, F.lit(END)))
    one = turns.select("conv_id", "_trained", "_bodies", parts.alias("_parts"), n.alias("_n"),
                       F.posexplode(ends).alias("example", "n_turns"))
    text = F.array_join(F.slice("_parts", F.lit(1), F.col("n_turns")), "")
    out = one.select("conv_id", "example", "n_turns", (F.col("n_turns") == F.col("_n")).alias("last"), text.alias("text"),
                     F.get("_trained", F.col("n_turns") - 1).alias("_target"),
                     F.length(F.get("_bodies", F.col("n_turns") - 1)).alias("_length"))
    end = F.when(F.col("_target"), F.length("text") - len(END))
    return out.select("conv_id", "example", "n_turns", "last", "text", (end - F.col("_length")).alias("loss_start"), end.alias("loss_end"))


def turns_of(text: Column) -> Column:
    """The (role, text) structs of a formatted example."""
    opening, closing = f"{START}{HEAD} ", f" {TAIL}"
    marked = F.split(text, END, -1)

    def turn(x: Column) -> Column:
        role = F.substring_index(x, closing, 1)
        return F.struct(unescaped(F.substring(role, F.lit(len(opening) + 1), F.length(role))).alias("role"),
                        unescaped(F.substring(x, F.length(role) + len(closing) + 1, F.length(x))).alias("text"))

    return F.transform(F.slice(marked, F.lit(1), F.size(marked) - 1), turn)


def trained_text(examples: DataFrame) -> Column:
    """The text under the loss mask, unescaped; null without any."""
    return unescaped(F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))


def read_back(examples: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the examples alone.

    The turns come from a conversation's longest example, the trained text
    from all its examples in order.
    """
    lines = F.array_join(F.transform(turns_of(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # What leaves an example: its length, its trained text and, from a last one, the digest of all turns.
    parts = examples.select(
        "conv_id", "example", "n_turns", F.length("text").cast("long").alias("_chars"), trained_text(examples).alias("_loss"),
        F.when(F.col("last"), F.sha2(F.encode(lines, "utf-8"), 256)).alias("_turns"))
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "_loss"))), lambda x: F.coalesce(x["_loss"], F.lit(""))), "")
    whole = parts.groupBy("conv_id").agg(F.max("n_turns").cast("long").alias("n_turns"), F.max("_turns").alias("turns_sha256"),
                                         loss.alias("_loss"), F.sum("_chars").alias("formatted_chars"))
    return whole.select("conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"),
                        F.sha2(F.encode("_loss", "utf-8"), 256).alias("loss_sha256"), "formatted_chars")
