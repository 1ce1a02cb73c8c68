"""Functions on array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

#: Items of a part, at least; longer arrays have parts as long as they have parts.
PART = 32


def scanned(items: Column, start: Column, step: Callable, out: Callable, kind: str) -> Column:
    """An array of out(state, item) for each item in order, where state is start before the first item and
    step(state, item) after each; `kind` is the type of its members.

    A fold that appends to an array copies it each time. So the items are dealt into parts: one fold finds the state before
    each part, another goes through each part, and n items cost n times the square root of n copies, not n times n.
    """
    none = F.array().cast(f"array<{kind}>")

    def parts_of(a: Column, width: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.floor((F.size(a) - 1) / width).cast("int"), F.lit(0)))
        return F.transform(numbers, lambda k: F.slice(a, k * width + 1, width))

    def states_of(parts: Column) -> Column:
        first = F.struct(start.alias("s"), F.array(start).alias("before"))

        def through(acc: Column, part: Column) -> Column:
            return bound(F.aggregate(part, acc["s"], step), lambda s: F.struct(s.alias("s"), F.array_append(acc["before"], s).alias("before")))

        return F.aggregate(parts, first, through)["before"]

    def of_part(part: Column, state: Column) -> Column:
        first = F.struct(state.alias("s"), none.alias("out"))
        return F.aggregate(part, first, lambda acc, x: F.struct(step(acc["s"], x).alias("s"), F.array_append(acc["out"], out(acc["s"], x)).alias("out")))["out"]

    def through_parts(parts: Column) -> Column:
        return bound(states_of(parts), lambda states: F.flatten(F.transform(parts, lambda part, k: of_part(part, F.get(states, k)))))

    width = lambda a: F.greatest(F.lit(PART), F.ceil(F.sqrt(F.size(a)))).cast("int")
    return bound(items, lambda a: F.when(F.size(a) > 0, bound(parts_of(a, width(a)), through_parts)).otherwise(none))
