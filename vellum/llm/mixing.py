"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, stored

_ITERATIONS = 60
_PRECISION = 1e-9
_BINS = 4096
_CELLS = 1024
#: Source tables up to this many rows are broadcast; larger ones are joined by shuffle.
_BROADCAST_SOURCES = 20_000


def beside(rows: DataFrame, numbers: DataFrame, sources: int, how: str = "inner") -> DataFrame:
    """rows with the columns that `numbers` has for their source, one row a source; null matches null."""
    numbers = numbers.withColumnRenamed("source", "of")
    joined = rows.join(F.broadcast(numbers) if sources <= _BROADCAST_SOURCES else numbers, F.col("source").eqNullSafe(F.col("of")), how)
    return joined.drop("of")


def targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """(source, source_size, target) from sizes(source, source_size), one row a source.

    Sources in code-point order, null last, weigh 1, 2, 3 and so on in turn. All sizes are shared
    by weight; a target stops at `most` times its source's size and what is above is shared
    again by weight among the others. The number of rows is the number of sources.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    rows = cut(sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn("full", F.lit(False)))
    limit = F.col("source_size") * F.lit(float(most))
    total = float(rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    while True:
        used = rows.agg(
            F.coalesce(F.sum(F.when(F.col("full"), limit)), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        unit = (total - used["fixed"]) / used["open"] if used["open"] else 0.0
        share = F.col("weight") * F.lit(unit)
        above = ~F.col("full") & (share > limit)
        if not rows.where(above).limit(1).count():
            return rows.select("source", "source_size", F.when(F.col("full"), limit).otherwise(share).alias("target"))
        rows = cut(rows.withColumn("full", F.col("full") | above))


def _rate(most: int) -> Column:
    """exp(tilt * size / mean size), held at `most`."""
    return F.when(F.col("all_of_it"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.col("size") / F.col("scale"))))


def tilts(histogram: DataFrame, goals: DataFrame, sources: int, most: int = 3) -> DataFrame:
    """(source, scale, tilt, all_of_it): the solution of each source's dual.

    Among the rates r in (0, most] with sum(r * size) = target, the one of least relative entropy to
    one copy of each document is min(most, exp(tilt * size / scale)). sum(r * size) grows with
    the tilt, so the dual is convex: every round is one Newton step for all sources at once over
    histogram(source, size, n), held inside the bracket known so far. A step that leaves it is
    replaced by the bracket's middle, or by a doubling where one end is unknown.
    """
    unknown = F.lit(None).cast("double")
    state = goals.select(
        "source",
        "target",
        F.when(F.col("docs") > 0, F.col("source_size") / F.col("docs")).otherwise(F.lit(1.0)).alias("scale"),
        (F.col("target") >= F.col("source_size") * F.lit(float(most)) * (1 - 1e-12)).alias("all_of_it"),
        F.lit(0.0).alias("tilt"),
        unknown.alias("low"),
        unknown.alias("high"),
        F.lit(False).alias("done"),
    )
    state = cut(state.coalesce(4))
    rate, z, gap, tilt = _rate(most), F.col("size") / F.col("scale"), F.col("target") - F.col("got"), F.col("tilt")
    for _ in range(_ITERATIONS):
        sums = (
            beside(histogram.where("size > 0"), state, sources)
            .groupBy("source")
            .agg(
                F.sum(F.col("n") * F.col("size") * rate).alias("got"),
                F.sum(F.when(rate < most, F.col("n") * F.col("size") * z * rate).otherwise(0.0)).alias("slope"),
            )
        )
        state = (
            beside(state, sums, sources, "left")
            .withColumn("low", F.when(gap > 0, tilt).otherwise(F.col("low")))
            .withColumn("high", F.when(gap < 0, tilt).otherwise(F.col("high")))
            # A bracket narrower than what the tilt is rounded to says no more.
            .withColumn("done", F.col("all_of_it") | F.col("got").isNull() | (F.abs(gap) <= F.col("target") * _PRECISION) | F.coalesce(F.col("high") - F.col("low") < 1e-9, F.lit(False)))
            .withColumn("reach", F.greatest(F.lit(1.0), 2 * F.abs(tilt)))
            .withColumn("newton", tilt + gap / F.when(F.col("slope") > 0, F.col("slope")))
            .withColumn("other", F.when(F.col("low").isNull(), tilt - F.col("reach")).when(F.col("high").isNull(), tilt + F.col("reach")).otherwise((F.col("low") + F.col("high")) / 2))
        )
        inside = (F.col("low").isNull() | (F.col("newton") > F.col("low"))) & (F.col("high").isNull() | (F.col("newton") < F.col("high"))) & (F.abs(F.col("newton") - tilt) <= F.col("reach"))
        step = F.when(F.col("done"), tilt).when(F.coalesce(inside, F.lit(False)), F.col("newton")).otherwise(F.col("other"))
        state = cut(state.select("source", "target", "scale", "all_of_it", step.alias("tilt"), "low", "high", "done").coalesce(4))
        if not state.where("NOT done").limit(1).count():
            break
    else:
        raise RuntimeError(f"the dual isn't solved after {_ITERATIONS} steps")
    # Sums of doubles may differ in their last bits from run to run; the rounded tilt doesn't.
    return cut(state.select("source", "scale", F.round("tilt", 7).alias("tilt"), "all_of_it"))


def mix(docs: DataFrame, most: int = 3) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken) for every row of docs.

    Each document gets floor(rate) or floor(rate) + 1 copies. A draw u in [0, 1), fixed by the
    document, takes the higher number if u / (the rate's fraction) is below a limit near 1, which
    is set for each source so that the words taken meet its target. The limit comes from a
    histogram of these quotients, refined once: no source is ever sorted in one task.

    Null texts have size 0 and are taken 0 times; null sources are one source, last in order;
    rows that are equal in id, source and text get the same draw, those without an id among them; an empty
    table gives no rows; other columns are not read. Reruns agree, however the rows are split over tasks.
    """
    sizes = stored(docs.select("doc_id", "source", *_sized()), "sizes")
    solved, limits, sources = _solved(sizes, most)
    out = _copied(sizes, solved, limits, sources, most)
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _sized() -> tuple[Column, Column]:
    """A row's size in words, and its draw, which follows from its id, source and text alone, wherever it is read again."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return size.alias("size"), F.xxhash64(F.lit("mix"), "doc_id", "source", "text").alias("draw")


def _rated(rows: DataFrame, solved: DataFrame, sources: int, most: int) -> DataFrame:
    """rows with the whole part of their rate, and the place among those of their source: small places get a further copy."""
    rows = beside(rows, solved, sources).withColumn("rate", F.when(F.col("size") > 0, _rate(most)).otherwise(0.0)).withColumn("whole", F.floor("rate").cast("long"))
    rows = rows.withColumn("place", F.when(F.col("rate") > F.col("whole"), F.shiftrightunsigned("draw", 11) / F.lit(float(1 << 53)) / (F.col("rate") - F.col("whole"))))
    rows = rows.withColumn("bin", F.when(F.col("place") < 2, F.floor(F.col("place") * (_BINS / 2))).otherwise(F.lit(_BINS)).cast("int"))
    return rows.withColumn("cell", F.pmod(F.xxhash64("draw"), F.lit(_CELLS)).cast("int")).drop("rate")


def _copied(rows: DataFrame, solved: DataFrame, limits: DataFrame, sources: int, most: int) -> DataFrame:
    """rows(source, size, draw, ...) with copies, source_size and target: what a row gets follows from itself and its source's few numbers."""
    rows = beside(_rated(rows, solved, sources, most), limits, sources, "left")
    # A source without an edge bin takes all its free copies.
    taken = F.col("place").isNotNull() & (F.col("edge").isNull() | (F.col("bin") < F.col("edge")) | ((F.col("bin") == F.col("edge")) & (F.col("cell") <= F.col("last"))))
    return rows.withColumn("copies", F.col("whole") + F.when(taken, 1).otherwise(0).cast("long"))


def _solved(sizes: DataFrame, most: int) -> tuple[DataFrame, DataFrame, int]:
    """The tilts of all sources, their limits of places with sizes and targets, and how many sources there are: a row a source each."""
    histogram = cut(sizes.groupBy("source", "size").agg(F.count("*").alias("n")))
    totals = cut(
        histogram.groupBy("source")
        .agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("docs"))
        .coalesce(4)
    )
    sources = totals.count()
    goal = cut(targets(totals.select("source", "source_size"), most).coalesce(4))
    solved = tilts(histogram, beside(goal, totals.select("source", "docs"), sources), sources, most)
    rated = stored(_rated(sizes, solved, sources, most).select("source", "size", "whole", "place", "bin", "cell"), "rates")
    free = rated.where("place IS NOT NULL")
    sure = rated.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("sure"))
    # The bins of a source are taken in order up to the edge bin, at most _BINS + 1 rows a source.
    bins = free.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    bins = bins.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("bin")) - F.col("words"))
    bins = beside(beside(bins, sure, sources), goal, sources).withColumn("rest", F.col("target") - F.col("sure") - F.col("before"))
    # The edge bin is the first that isn't wholly taken.
    edge = bins.where("rest < words").groupBy("source").agg(F.min_by(F.struct("bin", "rest"), "bin").alias("e")).select("source", F.col("e.bin").alias("edge"), F.col("e.rest").alias("rest"))
    edge = cut(edge.coalesce(4))
    # Within it, cells by another draw; a cell is taken if its middle lies inside what is left.
    inner = beside(free, edge, sources).where("bin = edge").groupBy("source", "cell").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
    inner = inner.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("cell")) - F.col("words"))
    last = inner.where("before + words / 2 <= rest").groupBy("source").agg(F.max("cell").alias("last"))
    same = F.col("source").eqNullSafe(F.col("of"))
    limits = edge.join(last.withColumnRenamed("source", "of"), same, "left").select("source", "edge", F.coalesce("last", F.lit(-1)).alias("last"))
    limits = goal.join(limits.withColumnRenamed("source", "of"), same, "left").drop("of")
    return solved, cut(limits.coalesce(4)), sources


def apply_mix(docs: DataFrame, most: int = 3) -> DataFrame:
    """docs with every row as often as the mix takes it, in docs' columns.

    What a row gets follows from itself and its source, so rows stay where they are, and rows that repeat an id, or have none, are taken each on their own.
    """
    sizes = stored(docs.select("source", *_sized()), "sizes")
    solved, limits, sources = _solved(sizes, most)
    # The row travels in a struct, so that its columns may have any names.
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), "source", *_sized())
    copies = _copied(rows, solved, limits, sources, most).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copies.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
