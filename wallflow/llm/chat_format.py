"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all preceding turns as context and
that reply as the only trainable text. Turns after the last reply are kept in
one more example without trainable text, so a conversation can be read back.

Template: ``<|im_start|>`` role, newline, text, ``<|im_end|>``, newline. Control
strings inside a text get a backslash after their bracket, runs of backslashes
there grow by one, and reading back removes it; so the step is reversible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"

# A bracket that begins a control string of this or a common other template.
_TAIL = r"(?=\||/?s>|/?INST\]|/?SYS>)"
_ESCAPE = r"([<\[])(\\*)" + _TAIL
_UNESCAPE = r"([<\[])\\(\\*)" + _TAIL


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2")


def expand_targets(df: DataFrame) -> DataFrame:
    """Rows ``conv_id, example, text, loss_start, loss_chars`` from rows ``conv_id, turn, role, text``.

    Turns are taken in order of ``turn``, ties by role and text, nulls first;
    repeated rows are turns of their own. Null role or text is empty. Offsets
    count code points from 0; an example without target has ``loss_chars`` 0 at
    the end of its text. A null ``conv_id`` is one conversation. An example
    holds all of its prefix, so a conversation must fit in a task as a row.
    Other columns are ignored; empty input, empty result.
    """
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turns = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    head = lambda t: F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n"))
    parts = turns.select(
        "conv_id",
        F.transform(
            "_turns",
            lambda t: F.struct(
                (t["role"] == "assistant").alias("target"),
                head(t).alias("head"),
                escape(t["text"]).alias("body"),
            ),
        ).alias("_parts"),
    )
    ends = F.filter(
        F.sequence(F.lit(1), F.size("_parts")),
        lambda i: F.element_at("_parts", i)["target"] | (i == F.size("_parts")),
    )
    rows = parts.select("conv_id", "_parts", F.posexplode(ends).alias("example", "_end"))
    close = F.lit(END + "\n")
    last = F.element_at("_parts", F.col("_end"))
    context = F.array_join(
        F.transform(F.slice("_parts", 1, F.col("_end") - 1), lambda p: F.concat(p["head"], p["body"], close)), ""
    )
    rows = rows.select("conv_id", "example", context.alias("_context"), last.alias("_last"))
    before = F.length("_context") + F.length("_last.head")
    text = F.concat("_context", "_last.head", "_last.body", close)
    return rows.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        text.alias("text"),
        F.when(F.col("_last.target"), before).otherwise(F.length(text)).cast("long").alias("loss_start"),
        F.when(F.col("_last.target"), F.length("_last.body")).otherwise(0).cast("long").alias("loss_chars"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples say of each conversation: its turns, and all text under the loss masks.

    The longest example has every turn; the loss text is joined in order of the examples.
    """
    loss = unescape(F.expr("substring(text, CAST(loss_start + 1 AS INT), CAST(loss_chars AS INT))"))
    whole = (
        examples.withColumn("_loss", loss)
        .groupBy("conv_id")
        .agg(
            F.max_by("text", "example").alias("_text"),
            F.sort_array(F.collect_list(F.struct("example", F.col("_loss").alias("loss")))).alias("_losses"),
            F.sum(F.length("text")).cast("long").alias("formatted_chars"),
        )
    )
    marked = F.filter(F.split("_text", r"<\|im_start\|>"), lambda p: p != "")
    split_at = lambda p: F.instr(p, "\n")
    role = lambda p: F.url_decode(F.substring_index(p, "\n", 1))
    body = lambda p: unescape(
        F.substr(p, split_at(p) + 1, F.length(p) - split_at(p) - F.lit(len(END) + 1))
    )
    turns = F.transform(marked, lambda p: F.concat(role(p), F.lit("\n"), body(p), F.lit("\n")))
    joined = F.array_join(F.transform("_losses", lambda x: x["loss"]), "")
    return whole.select(
        "conv_id",
        F.size(marked).cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(joined).cast("long").alias("loss_chars"),
        F.sha2(joined, 256).alias("loss_sha256"),
        "formatted_chars",
    )
