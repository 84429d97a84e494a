"""Ordered folds over arrays that give a value for each element, in about n ** 1.5 steps.

A fold that appends to an array copies it at every step. Here elements are taken in blocks of about the square root of their
number: a block's values are appended to an array of that size, and blocks to an array of blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliate.functions.text import let


def running(xs: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], state_kind: str, out_kind: str, last: Callable[[Column], Column] | None = None) -> Column:
    """The array of values that ``step`` gives, one for each element, null where it gives none; ``step`` gets the state and an
    element and returns the next state and the value. ``last`` makes one more value of the final state. Kinds are the
    types of state and value; an empty array has the last value alone."""
    block_kind = f"struct<s:{state_kind},o:array<{out_kind}>>"
    whole_kind = f"struct<s:{state_kind},o:array<array<{out_kind}>>>"
    pack = lambda s, o, kind: F.struct(s.alias("s"), o.alias("o"))

    def one(acc: Column, x: Column) -> Column:
        state, value = step(acc["s"], x)
        return pack(state, F.concat(acc["o"], F.array(value)), block_kind)

    def many(acc: Column, block: Column) -> Column:
        begin = pack(acc["s"], F.array().cast(f"array<{out_kind}>"), block_kind)
        return F.aggregate(block, begin, one, lambda r: pack(r["s"], F.concat(acc["o"], F.array(r["o"])), whole_kind))

    def folded(a: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(a))).cast("int")
        places = F.when(F.size(a) > 0, F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.greatest(size, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        blocks = F.transform(places, lambda i: F.slice(a, i, F.greatest(size, F.lit(1))))
        begin = pack(start.cast(state_kind), F.array().cast(f"array<array<{out_kind}>>"), whole_kind)
        done = lambda r: F.flatten(r["o"]) if last is None else F.concat(F.flatten(r["o"]), F.array(last(r["s"])))
        return F.aggregate(blocks, begin, many, done)

    return let(xs, folded)


def run_lengths(items: Column) -> Column:
    """(word, n) of the distinct items, in order: equal ones are runs of the sorted array, counted by where runs end."""

    def counted(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        ends = F.filter(places, lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i + 1)) | (i == F.size(s) - 1))
        length = lambda e, i, p: (p - F.when(i > 0, F.get(e, i - 1)).otherwise(-1)).cast("bigint")
        return let(ends, lambda e: F.transform(e, lambda p, i: F.struct(F.get(s, p).alias("word"), length(e, i, p).alias("n"))))

    return let(F.sort_array(items), counted)  # array_sort would compare by an expression
