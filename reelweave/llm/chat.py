"""Chat formatting as Spark expressions: sorted turn structs, merged roles, one string per conversation.

Turns are collected as structs, sorted by (turn, role, text) and adjacent turns of one role merged
into a block by array aggregation.  A block reads ``<|im_start|>role\\ntext<|im_next|>text<|im_end|>``;
``<|im_next|>`` stands between the turns that a block merges, so the format can be read back turn by
turn.  Backslashes and control strings inside texts and roles are escaped with backslashes, which
``unescape`` takes out again; an escaped text holds no control string.

The loss mask covers the text of the trained roles: spans of code points in the formatted string.

A conversation is one row of the result by definition, so its turns meet in one task; conversations
are spread by id, and only (turn, role, text) is shuffled.

Defined cases: null text or role is empty; a null conv_id is a conversation of its own; repeated rows
are turns of their own; ties of ``turn`` are ordered by role, then text, null turns first; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelweave.functions.text import bound
from reelweave.llm._lists import running, substrings

#: The marks of the template and further strings that models treat as control strings.
START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>"
CONTROL = [START, NEXT, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def escape(s: Column) -> Column:
    """Backslashes doubled, a backslash after the first character of each control string."""
    s = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        s = F.replace(s, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return s


def unescape(s: Column) -> Column:
    """Each backslash taken out, the character after it kept."""
    return F.regexp_replace(s, r"(?s)\\(.)", "$1")


def blocks(turns: str, starts: str) -> Column:
    """Adjacent turns of one role as one block: array of (role, texts).

    ``turns`` is a column of (turn, role, text) arrays, ``starts`` one of the places where blocks begin: each
    block is a slice of the turns, so the work grows with their number only.
    """
    t, s = F.col(turns), F.col(starts)

    def block(at, k):
        stop = F.coalesce(F.get(s, k + 1), F.size(t))
        return F.struct(F.get(t, at)["role"].alias("role"), F.transform(F.slice(t, at + 1, stop - at), lambda x: x["text"]).alias("texts"))

    return F.transform(s, block)


def block_starts(turns: str) -> Column:
    """Places of the turns whose role differs from the one before."""
    t = F.col(turns)
    return F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))


def _block(b: Column) -> Column:
    role = F.replace(escape(b["role"]), F.lit("\n"), F.lit("\\\n"))
    return F.concat(F.lit(START), role, F.lit("\n"), F.array_join(F.transform(b["texts"], escape), NEXT), F.lit(END))


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, blocks) with each conversation's turns sorted and merged."""
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sorted_ = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return sorted_.withColumn("starts", block_starts("turns")).select("conv_id", blocks("turns", "starts").alias("blocks"))


def render(rows: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss): the string of each conversation and its loss spans (start, end)."""
    built = conversations(rows).select("conv_id", "blocks", F.array_join(F.transform("blocks", _block), "").alias("formatted"))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def spans(b, at):
        first = at + F.char_length(_block(F.struct(b["role"].alias("role"), F.array().cast("array<string>").alias("texts")))) - len(END)
        sizes = F.transform(b["texts"], lambda t: F.char_length(escape(t)))
        span = lambda n, off: F.struct((first + off).cast("int").alias("start"), (first + off + n).cast("int").alias("end"))
        return bound(sizes, lambda held: F.zip_with(held, running(F.transform(held, lambda n: n + len(NEXT))), span))

    starts = running(F.transform("blocks", lambda b: F.char_length(_block(b))))
    loss = F.flatten(F.zip_with("blocks", starts, lambda b, at: F.when(b["role"].isin(*trained), spans(b, at)).otherwise(empty)))
    return built.select("conv_id", "formatted", loss.alias("loss"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) per turn from a formatted conversation."""
    parts = F.filter(F.split(formatted, r"\Q" + START + r"\E", -1), lambda p: p != "")

    def turns(p):
        role = F.regexp_extract(p, r"\A((?:[^\\\n]|\\[\s\S])*+)\n", 1)
        body = F.substring(p, F.char_length(role) + 2, F.char_length(p) - F.char_length(role) - 1 - len(END))
        return F.transform(F.split(body, r"\Q" + NEXT + r"\E", -1), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(parts, turns))


def digest(rendered: DataFrame) -> DataFrame:
    """Counts and digests of what the formatted strings and loss masks say."""
    turns = read_back(F.col("formatted"))
    lossy = F.array_join(F.transform(substrings(F.col("formatted"), F.col("loss")), unescape), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rendered.select("conv_id", "formatted", turns.alias("turns"), lossy.alias("lossy")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("lossy").cast("long").alias("loss_chars"),
        F.sha2(F.col("lossy").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
