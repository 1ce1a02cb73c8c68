"""Running values over ordered rows, however many of them one key has.

A key whose rows fit a task is a window. A longer one is cut into parts by its rows' places. Each part is summed up on its own, before any shuffle of rows:
what it adds to a total, its last value, its greatest. The sums of the parts before it are what enters a part, and its rows go on from there in a
window of the key and part. So a key of a third of all rows is dealt over as many tasks as it has parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.landing import landed

#: Rows of a key that one task sorts and walks, at most, and places of a part of a longer one.
WHOLE, PART = 1 << 20, 1 << 16


@dataclass(frozen=True)
class Value:
    """What runs: a total, the last that isn't null, or the greatest, of the rows up to each, or only of those before it."""

    kind: str
    of: Column
    before: bool = False


def total(of: Column) -> Value:
    return Value("total", of)


def last(of: Column, before: bool = False) -> Value:
    return Value("last", of, before)


def most(of: Column) -> Value:
    return Value("most", of)


def previous(of: Column) -> Value:
    """The row before, as a struct with the field x, so that a null there isn't passed over; null for the first."""
    return Value("last", F.struct(of.alias("x")), True)


def number() -> Value:
    """A row's place among those of its key, from 1."""
    return Value("total", F.lit(1).cast("long"))


def fits(rows: DataFrame, key: str) -> bool:
    """Whether no key has more rows than one task walks. One pass over the keys, summed up before the shuffle."""
    longest = rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return (longest or 0) <= WHOLE


def _over(value: Value, window) -> Column:
    w = window.rowsBetween(Window.unboundedPreceding, -1 if value.before else Window.currentRow)
    return {"total": lambda: F.sum(value.of), "last": lambda: F.last(value.of, True), "most": lambda: F.max(value.of)}[value.kind]().over(w)


def _same(left: list[str], right: list[str]) -> Column:
    on = F.lit(True)
    for a, b in zip(left, right, strict=True):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def part_of(place: str) -> Column:
    return F.floor(F.col(place) / PART).cast("long")


def running(rows: DataFrame, keys: list[str], order: list[str], whole: bool, **values: Value) -> DataFrame:
    """rows with a column for each running value, over the rows of equal keys in the given order.

    The first column of the order is a row's place, a number that doesn't fall within a key. whole says that all keys fit a task, as `fits` finds out. Rows equal
    in all of the order come in any order. Nulls are a key of their own, and come first in order.
    """
    if whole:
        by = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumns({c: _over(v, by) for c, v in values.items()})
    rows = landed(rows.withColumn("_part", part_of(order[0])), "parts")
    at = F.struct(*order)
    sums = {"total": lambda v: F.sum(v.of), "most": lambda v: F.max(v.of), "last": lambda v: F.max_by(v.of, F.when(v.of.isNotNull(), at))}
    parts = rows.groupBy(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_part").alias("_of_part")).agg(*(sums[v.kind](v).alias(f"_{c}") for c, v in values.items()))
    earlier = Window.partitionBy(*(f"_of_{k}" for k in keys)).orderBy("_of_part")
    entering = {c: _over(Value(v.kind, F.col(f"_{c}"), True), earlier) for c, v in values.items()}
    entering = parts.select(*(f"_of_{k}" for k in keys), "_of_part", *(x.alias(f"_{c}") for c, x in entering.items()))
    by = Window.partitionBy(*keys, "_part").orderBy(*order)
    here = rows.withColumns({c: _over(v, by) for c, v in values.items()})
    joined = here.join(entering, _same([*keys, "_part"], [*(f"_of_{k}" for k in keys), "_of_part"]))
    both = {"total": lambda c: F.coalesce(F.col(f"_{c}") + F.col(c), f"_{c}", c), "last": lambda c: F.coalesce(c, f"_{c}"), "most": lambda c: F.greatest(c, f"_{c}")}
    return joined.select(*rows.drop("_part").columns, *(both[v.kind](c).alias(c) for c, v in values.items()))


def over_all(rows: DataFrame, keys: list[str], whole: bool, **of: Column) -> DataFrame:
    """rows with an aggregate of all rows of equal keys in every one of them."""
    if whole:
        return rows.withColumns({c: x.over(Window.partitionBy(*keys)) for c, x in of.items()})
    rows = landed(rows, "rows")
    sums = rows.groupBy(*(F.col(k).alias(f"_of_{k}") for k in keys)).agg(*(x.alias(c) for c, x in of.items()))
    return rows.join(sums, _same(keys, [f"_of_{k}" for k in keys])).select(*rows.columns, *of)


# A machine whose state is a number that rises by what it meets, in two stages. What a part does to it is a table from every number it can begin with.

#: The greatest number that a line can set.
TOP = 9999


def passage(events: list[tuple[int | None, bool, bool]], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """What a part makes of every state it can begin with: two rows, for stage 0 and 1, of TOP + 2 numbers, and the stages after them.

    events in order: (number or None, opens stage 1, splits). The last column stands for all numbers above TOP, which no line can set: it holds what is added to them, or the
    number itself where the part opens a stage and so forgets them.
    """
    known = [np.arange(TOP + 2), np.arange(TOP + 2)]  # the numbers that are still apart, and which of them every state has come to
    at = [np.arange(TOP + 2), np.arange(TOP + 2)]
    stage = [0, 1]
    high = 1 << 40  # above TOP, and known again at the end
    for k in (0, 1):
        known[k][-1] = high
    opened = False
    for i, (n, opens, splits) in enumerate(events):
        if opens:
            known, at, stage, opened = [np.zeros(1, dtype=np.int64)] * 2, [np.zeros(TOP + 2, dtype=np.int64)] * 2, [1, 1], True
            continue
        for k in (0, 1):
            now = known[k]
            if splits and stage[k] == 1:
                known[k] = now + 1
            elif n is not None:
                known[k] = np.where((n > now) & (n - now <= reach), n, now)
        if i % 64 == 63:
            for k in (0, 1):
                known[k], inverse = np.unique(known[k], return_inverse=True)
                at[k] = inverse[at[k]]
    out = np.stack([known[k][at[k]] for k in (0, 1)])
    if not opened:
        out[:, -1] -= high
    return out, np.array([stage[0], stage[1], int(opened)])


def passed(state: tuple[int, int], table: np.ndarray, stages: np.ndarray) -> tuple[int, int]:
    """The state (stage, number) after a part."""
    stage, now = state
    if now <= TOP:
        return int(stages[stage]), int(table[stage, now])
    return int(stages[stage]), int(table[stage, -1]) + (0 if stages[2] else now)


def entering(events: DataFrame, reach: int) -> DataFrame:
    """(of, of_part, stage, now): the state in which every part of events(book, part, place, number, opens, splits) begins, for the parts after the first that has events.

    Parts are turned into tables where they lie; a book's tables then go through one task one after the other, never together.
    """

    def tabled(group: pa.Table) -> pa.Table:
        rows = group.sort_by("place")
        table, stages = passage(list(zip(*(rows.column(c).to_pylist() for c in ("number", "opens", "splits")), strict=True)), reach)
        return pa.table([rows.column("book").slice(0, 1), rows.column("part").slice(0, 1), pa.array([np.append(table, stages).astype(np.int64).tobytes()])], names=["book", "part", "map"])

    kind = events.schema["book"].dataType.simpleString()
    tables = events.groupBy("book", "part").applyInArrow(tabled, f"book {kind}, part long, map binary")

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, state, begun = None, (0, 0), False
        for batch in batches:
            stages, numbers = [], []
            for own, raw in zip(batch.column("book").to_pylist(), batch.column("map"), strict=True):
                if not begun or own != book:
                    book, state, begun = own, (0, 0), True
                flat = np.frombuffer(raw.as_buffer(), np.int64)
                state = passed(state, flat[:-3].reshape(2, -1), flat[-3:])
                stages.append(state[0])
                numbers.append(state[1])
            yield pa.RecordBatch.from_arrays([batch.column("book"), batch.column("part"), pa.array(stages, pa.int32()), pa.array(numbers, pa.int64())], names=["of", "of_part", "stage", "now"])

    return tables.repartition("book").sortWithinPartitions("book", "part").mapInArrow(walked, f"of {kind}, of_part long, stage int, now long")
