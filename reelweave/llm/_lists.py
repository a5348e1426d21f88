"""Running folds over arrays and many substrings of one text, as expressions whose work grows with the length only.

An array that grows by one item in a fold is copied each time, and a substring is looked for from the text's
beginning, so either done for every item costs the square of their number.  Here arrays are folded in chunks of CHUNK
that begin with the fold of the chunks before, and a text is cut into pieces of PIECE characters once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelweave.functions.text import bound

CHUNK, PIECE = 128, 4096


def running(values: Column, add: Callable[[Column, Column], Column] = lambda a, v: a + v) -> Column:
    """Of an int array the fold of all values before each one, from 0 on; ``add`` is associative with 0 as its neutral value."""
    zero = F.lit(0)

    def chunked(v):
        chunks = F.transform(F.sequence(zero, F.ceil(F.size(v) / CHUNK).cast("int") - 1), lambda c: F.slice(v, c * CHUNK + 1, CHUNK))
        return F.when(F.size(v) > 0, bound(chunks, folded)).otherwise(F.array().cast("array<int>"))

    def folded(chunks):
        sums = F.transform(chunks, lambda x: F.aggregate(x, zero, add))

        def starts(s):
            return F.transform(s, lambda _, c: F.aggregate(F.slice(s, 1, c), zero, add))

        def inner(x, start):
            first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
            return F.aggregate(x, first, lambda a, v: F.struct(add(a["at"], v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

        return F.flatten(F.zip_with(chunks, bound(sums, starts), inner))

    return bound(values, chunked)


def substrings(text: Column, spans: Column) -> Column:
    """The part of a text in each span (start, end) of an array, in its order; nulls without a text."""
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.char_length(text) / PIECE).cast("int")), lambda k: F.substring(text, k * PIECE + 1, PIECE))

    def part(pieces, s):
        first = F.floor(s["start"] / PIECE).cast("int")
        held = F.slice(pieces, first + 1, F.floor(s["end"] / PIECE).cast("int") - first + 1)
        return F.substring(F.array_join(held, ""), s["start"] - first * PIECE + 1, s["end"] - s["start"])

    return bound(cut, lambda pieces: F.transform(spans, lambda s: part(pieces, s)))
