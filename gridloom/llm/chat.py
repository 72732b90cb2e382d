"""Chat formatting with Spark expressions only.

Turns are collected per conversation as structs and sorted; runs of one role become blocks; a block is written as

    <|im_start|>role\\n text [<|im_sep|> text ...] <|im_end|>\\n

The control strings below never occur inside a text or role: each occurrence gets a backslash after its first character, and
one that already looks escaped gets one more, so that unescaping gives back every text exactly.

Nulls: a null text or role counts as empty. Each row with a null conversation id is a conversation of its own, as nothing says which
of them belong together; so they are never gathered. Turns sort by turn (null first), then role, then text, so that ties and
repeated rows have one order. Blocks keep the borders of their turns. An empty table gives no rows; extra columns, whatever their
names, are ignored. Texts of any length are written whole; a conversation must fit into a task, as its output is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Control strings of this and of other public chat templates, without their first character, which is < or [.
CONTROL = r"\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>|/?INST\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"([<\[])(\\*)(?={CONTROL})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={CONTROL})", "$1$2")


def _role_out(role: Column) -> Column:
    """A role on one line: backslash and newline are spelt out."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def _role_in(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\")))


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per conversation: conv, formatted, mask (runs of characters as structs chars, loss: true inside the texts of the
    trained role, separators and marks excluded)."""
    rows = turns.select(F.col(conv).alias("conv"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.where("conv is not null").groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    sorted_turns = sorted_turns.unionByName(rows.where("conv is null").select("conv", F.array("t").alias("turns")))
    n = F.size("turns")
    starts = sorted_turns.withColumn("starts", F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("turns", i).role != F.get("turns", i - 1).role)))
    blocks = starts.withColumn(
        "blocks",
        F.transform(
            "starts",
            lambda at, k: F.struct(
                F.get("turns", at).role.alias("role"),
                F.transform(F.slice("turns", at + 1, F.coalesce(F.get("starts", k + 1), n) - at), lambda t: escape(t.text)).alias("texts"),
            ),
        ),
    )
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    mark = lambda text: segment(text, F.lit(False))
    head = lambda b: F.concat(F.lit(START), _role_out(b.role), F.lit("\n"))
    said = lambda b: lambda t, i: F.when(i == 0, F.array(segment(t, b.role == trained))).otherwise(F.array(mark(F.lit(SEP)), segment(t, b.role == trained)))
    segments = blocks.select("conv", F.flatten(F.transform("blocks", lambda b: F.concat(F.array(mark(head(b))), F.flatten(F.transform(b.texts, said(b))), F.array(mark(F.lit(END)))))).alias("segments"))
    return segments.select(
        F.col("conv").alias(conv),
        F.array_join("segments.text", "").alias("formatted"),
        F.transform("segments", lambda x: F.struct(F.length(x.text).cast("long").alias("chars"), x.loss.alias("loss"))).alias("mask"),
    )


def parse_chat(formatted: Column) -> Column:
    """Blocks of a formatted conversation: array of structs head (as written), role, texts (as written, still escaped)."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b != "")
    head = lambda b: F.concat(F.substring_index(b, "\n", 1), F.lit("\n"))
    return F.transform(
        blocks,
        lambda b: F.struct(
            head(b).alias("head"),
            _role_in(F.substring(F.substring_index(b, "\n", 1), F.lit(len(START) + 1), F.length(b))).alias("role"),
            F.split(F.substring(b, F.length(head(b)) + 1, F.length(b)), r"<\|im_sep\|>", -1).alias("texts"),
        ),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of structs role, text."""
    return F.flatten(F.transform(parse_chat(formatted), lambda b: F.transform(b.texts, lambda t: F.struct(b.role.alias("role"), unescape(t).alias("text")))))


def read_trained(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between; an error where mask and text don't fit together."""
    pieces = lambda b: F.concat(F.array(b.head), F.flatten(F.transform(b.texts, lambda t, i: F.when(i == 0, F.array(t)).otherwise(F.array(F.lit(SEP), t)))), F.array(F.lit(END)))
    pairs = F.zip_with(F.flatten(F.transform(parse_chat(formatted), pieces)), mask, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    fits = ~F.exists(pairs, lambda x: ~F.length(x.p).eqNullSafe(x.m.chars))
    text = F.array_join(F.transform(F.filter(pairs, lambda x: x.m.loss), lambda x: unescape(x.p)), "")
    return F.when(fits, text).otherwise(F.raise_error(F.lit("the mask does not fit the text")).cast("string"))
