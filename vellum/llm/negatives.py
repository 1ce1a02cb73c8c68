"""Hard negatives: rows of another label that are nearly as close to an anchor as its positives, found exactly.

Vectors are rotated to their leading principal axes. For a pair the products of the leading components are summed first; what
the others can add is bounded by the norms of the two remainders (Cauchy and Schwarz), with slack for rounding. Most pairs are
discarded after a few components; the rest are decided by the integer products themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored
from .embeddings import _matrix, _principal

#: Rows whose vec_id is a multiple are anchors; so many positives of each, and negatives of each positive.
EVERY, POSITIVES, NEGATIVES = 100, 5, 5
#: Leading components that are rotated: seven eighths of all, and AXES at most. Pairs are discarded after one, four and all sevenths of them.
AXES = 256
#: Bytes of the anchors, and of the rows, that one call holds, about.
BLOCK = 32 << 20
#: Anchors and rows whose products are made at once.
TILE, CHUNK = 1024, 512
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
#: Above it, squares of components could overflow: such blocks aren't bounded but multiplied.
_HUGE = 1e140


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 * x), in doubles, which hold it exactly."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(256.0 * x), -np.finfo(np.float64).max, np.finfo(np.float64).max)


def stages(leading: int) -> list[int]:
    return sorted({-(-leading * k // 7) for k in (1, 4, 7)} - {0})


class Rotated:
    """Vectors with their leading components, and the norm of what is left after each stage."""

    def __init__(self, x: np.ndarray, axes: np.ndarray):
        self.x = x
        self.top = float(np.abs(x).max(initial=0.0))
        self.fits = self.top < _HUGE
        if not self.fits:
            return
        self.y = x @ axes
        square = (x * x).sum(axis=1)
        self.norm = np.sqrt(square)
        # Cancellation can make a remainder too small, by no more than this share of the whole.
        left = [square - (self.y[:, :s] ** 2).sum(axis=1) for s in stages(axes.shape[1])]
        self.rest = [np.sqrt(np.maximum(r, 0) + 1e-11 * square) for r in left]


def products(a: Rotated, b: Rotated, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The integer inner products of a's vectors i with b's vectors j; beyond 64 bits they are held at the ends."""
    most = a.top * b.top * a.x.shape[1]
    if most < 1 << 62:
        return np.einsum("ij,ij->i", a.x[i].astype(np.int64), b.x[j].astype(np.int64))
    out = [sum(int(p) * int(q) for p, q in zip(a.x[m].tolist(), b.x[n].tolist(), strict=True)) for m, n in zip(i.tolist(), j.tolist(), strict=True)]
    return np.array([min(max(v, _LEAST + 1), _MOST) for v in out], dtype=np.int64)


def survivors(a: Rotated, rows: slice, b: Rotated, columns: slice, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, product) of the wanted pairs of a's rows and b's columns whose product may lie in low to high, an interval for each row."""
    if not (a.fits and b.fits):
        i, j = np.nonzero(wanted)
        return i, j, products(a, b, i + rows.start, j + columns.start)
    slack = 1e-9 * (a.norm[rows, None] * b.norm[columns]) + 1e-6
    low, high = low - 1e-9 * np.where(np.isfinite(low), np.abs(low), 0), high + 1e-9 * np.where(np.isfinite(high), np.abs(high), 0)
    i = j = None  # once few pairs are left, they are listed
    part, before, live = np.zeros(wanted.shape), 0, wanted
    for stage, until in enumerate(stages(a.y.shape[1])):
        p, q, r, s = a.y[rows, before:until], b.y[columns, before:until], a.rest[stage][rows], b.rest[stage][columns]
        if i is None:
            part += p @ q.T
            rest = r[:, None] * s + slack
            live = live & (part + rest >= low[:, None]) & (part - rest <= high[:, None])
            if np.count_nonzero(live) * 8 <= wanted.size:
                i, j = np.nonzero(live)
                part = part[i, j]
        else:
            part += np.einsum("ij,ij->i", p[i], q[j])
            rest = r[i] * s[j] + slack[i, j]
            left = (part + rest >= low[i]) & (part - rest <= high[i])
            i, j, part = i[left], j[left], part[left]
        before = until
    if i is None:
        i, j = np.nonzero(live)
        if a.top * b.top * a.x.shape[1] < 1 << 52:
            # Where most pairs are left, all are multiplied at once: doubles hold these integers.
            return i, j, (a.x[rows] @ b.x[columns].T)[i, j].astype(np.int64)
    return i, j, products(a, b, i + rows.start, j + columns.start)


class Best:
    """The first k of each key so far: the highest products, then the smallest ids."""

    def __init__(self, keys: int, k: int):
        self.k = k
        self.key, self.product, self.id, self.at = (np.zeros(0, dtype=np.int64) for _ in range(4))
        #: The product and id that a newcomer has to beat.
        self.last, self.last_id = np.full(keys, _LEAST), np.full(keys, _MOST)

    def add(self, key: np.ndarray, product: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        better = (product > self.last[key]) | (product == self.last[key]) & (ids <= self.last_id[key])
        if not better.any():
            return
        new = zip((self.key, self.product, self.id, self.at), (key, product, ids, at), strict=True)
        key, product, ids, at = (np.concatenate([old, x[better]]) for old, x in new)
        order = np.lexsort((at, ids, -product, key))
        key = key[order]
        nth = np.arange(len(key)) - np.searchsorted(key, key)
        kept = order[nth < self.k]
        self.product, self.id, self.at = product[kept], ids[kept], at[kept]
        self.key = key[nth < self.k]
        full = nth == self.k - 1
        self.last[key[full]], self.last_id[key[full]] = product[order[full]], ids[order[full]]


def _side(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, ids (a null as the largest), labels and vectors."""
    ids = table.column("vec_id").to_numpy()
    if ids.dtype != np.int64:
        ids = np.array([_MOST if x is None else x for x in table.column("vec_id").to_pylist()], dtype=np.int64)
    x = _matrix(table.column("embedding").combine_chunks()) if table.num_rows else np.zeros((0, 0))
    return table.column("rid").to_numpy(), ids, table.column("label").to_numpy(), whole(x)


def nearest_positives(anchors: pa.Table, rows: pa.Table, axes: np.ndarray, k: int = POSITIVES) -> Best:
    """The first k rows of its own label for each anchor, among these rows, without the anchor itself."""
    rid, _, label, x = _side(anchors)
    rid2, ids, label2, x2 = _side(rows)
    a, b = Rotated(x, axes), Rotated(x2, axes)
    best = Best(len(rid), k)
    for t in range(0, len(rid), TILE):
        tile = slice(t, min(t + TILE, len(rid)))
        for c in range(0, len(rid2), CHUNK):
            part = slice(c, min(c + CHUNK, len(rid2)))
            wanted = (label[tile, None] == label2[part]) & (rid[tile, None] != rid2[part])
            low = np.where(best.last[tile] == _LEAST, -np.inf, best.last[tile].astype(np.float64))
            i, j, product = survivors(a, tile, b, part, low, np.full(len(low), np.inf), wanted)
            best.add(i + t, product, ids[j + c], j + c)
    return best


def nearest_negatives(anchors: pa.Table, rows: pa.Table, axes: np.ndarray, scores: np.ndarray, k: int = NEGATIVES) -> Best:
    """The first k rows of another label for each anchor and positive, among these rows, with a product of 80 to 100 parts in a hundred of the positive's.

    scores: the products of each anchor's positives, a row an anchor; a negative one stands for none and has none.
    """
    _, _, label, x = _side(anchors)
    _, ids, label2, x2 = _side(rows)
    a, b = Rotated(x, axes), Rotated(x2, axes)
    width = scores.shape[1]
    best = Best(len(label) * width, k)
    some = scores >= 0
    least = scores // 5 * 4 + (scores % 5 * 4 + 4) // 5  # four fifths, rounded up, without an overflow
    highest = np.where(some, scores.astype(np.float64), -np.inf).max(axis=1, initial=-np.inf)
    for t in range(0, len(label), TILE):
        tile = slice(t, min(t + TILE, len(label)))
        for c in range(0, len(label2), CHUNK):
            part = slice(c, min(c + CHUNK, len(label2)))
            wanted = (label[tile, None] != label2[part]) & some[tile].any(axis=1)[:, None]
            held = np.maximum(best.last.reshape(-1, width)[tile], least[tile])
            low = np.where(some[tile], held.astype(np.float64), np.inf).min(axis=1, initial=np.inf)
            i, j, product = survivors(a, tile, b, part, low, highest[tile], wanted)
            for n in range(width):
                inside = some[i + t, n] & (product >= least[i + t, n]) & (product <= scores[i + t, n])
                best.add((i[inside] + t) * width + n, product[inside], ids[j[inside] + c], j[inside] + c)
    return best


def _met(anchors: DataFrame, rows: DataFrame, groups: int, packs: int, run, schema: str) -> DataFrame:
    """run on every block of anchors with every block of rows."""
    of = lambda n: F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select(of(packs).alias("pack"), every(groups).alias("block"), *(F.col(c).alias(c) for c in anchors.columns))
    right = rows.select(every(packs).alias("of_pack"), of(groups).alias("of_block"), *(F.col(c).alias(c) for c in rows.columns))
    return left.groupBy("pack", "block").cogroup(right.groupBy("of_pack", "of_block")).applyInArrow(run, schema)


def _first(found: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    """The first k rows of each key, numbered from 1; every task drops what can't be among them before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def _usable(embedding: Column) -> Column:
    return F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def hard_negatives(vectors: DataFrame, every: int = EVERY) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the hard negatives of vectors(vec_id, embedding, label).

    Anchors are the rows whose vec_id is a multiple of `every`. A component x counts as floor(256 * x); a row's score is its inner product with the anchor. Rows go by
    score from the highest, equal ones by vec_id from the smallest. An anchor's positives are its first five other rows of its label; a positive's negatives
    are the first five rows of other labels whose score is 80 to 100 hundredths of its own: none, if that is negative. Of rows whose vec_id is a multiple of 7 the label counts as (label + 1) % 10.

    Rows with a null label or vector, or with a null or non-finite component, take no part. Vectors of different lengths aren't compared; those of no components all score 0. A null vec_id is no
    anchor and comes after the others. Rows that repeat an id are rows of their own: each is another row to its copies, and an anchor of its own. Scores beyond 64 bits are held at
    their ends. An empty table gives no rows. Other columns are not read.

    All anchors meet all rows in blocks of bounded size, spread by hashes, so labels and copies of any number change nothing; a block returns five rows an anchor, or an anchor and positive, at most.
    """
    spark = vectors.sparkSession
    number = F.col("vec_id").cast("long")
    label = F.when(number % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = vectors.select(number.alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & _usable(F.col("embedding")))
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    anchor = F.col("vec_id") % every == 0
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"), F.count(F.when(anchor, 1)).alias("anchors")).collect()  # one row a vector length
    out = None
    for d, n, some in sorted(map(tuple, sizes)):
        if some:
            own = rows.where(F.size("embedding") == d)
            parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
            groups = max(min(4 * parts, math.ceil(n / CHUNK)), math.ceil(8 * d * n / BLOCK))
            packs = max(1, math.ceil(8 * d * some / BLOCK))
            found = _of_length(own, own.where(anchor), d, groups, packs)
            out = found if out is None else out.unionByName(found)
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame([], names) if out is None else out


_POSITIVE = "anchor long, anchor_id long, vec_id long, rid long, score long"
_NEGATIVE = "anchor long, nth int, vec_id long, rid long, score long"


def _of_length(rows: DataFrame, anchors: DataFrame, d: int, groups: int, packs: int) -> DataFrame:
    leading = min(-(-d * 7 // 8), AXES)
    axes = _principal(rows.where(F.exists("embedding", lambda x: x != 0)), d, leading) if d else np.zeros((0, 0))

    def positives(left: pa.Table, right: pa.Table) -> pa.Table:
        best = nearest_positives(left, right, axes) if left.num_rows and right.num_rows else Best(0, 0)
        of, found = left.take(best.key), right.take(best.at)
        return pa.table([of.column("rid"), of.column("vec_id"), found.column("vec_id"), found.column("rid"), pa.array(best.product)], names=[x.split()[0] for x in _POSITIVE.split(", ")])

    def negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        best = Best(0, 0)
        if left.num_rows and right.num_rows:
            scores = np.array([(x + [-1] * POSITIVES)[:POSITIVES] for x in left.column("scores").to_pylist()], dtype=np.int64)
            best = nearest_negatives(left, right, axes, scores)
        of, found = left.take(best.key // POSITIVES), right.take(best.at)
        nth = pa.array((best.key % POSITIVES + 1).astype(np.int32))
        return pa.table([of.column("rid"), nth, found.column("vec_id"), found.column("rid"), pa.array(best.product)], names=[x.split()[0] for x in _NEGATIVE.split(", ")])

    found = _met(anchors, rows, groups, packs, positives, _POSITIVE)
    chosen = cut(_first(found, ["anchor"], POSITIVES, "nth").select("anchor", "anchor_id", "nth", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    scores = chosen.groupBy(F.col("anchor").alias("of")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    anchors = anchors.join(scores, F.col("rid") == F.col("of")).drop("of")
    found = _first(_met(anchors, rows, groups, packs, negatives, _NEGATIVE), ["anchor", "nth"], NEGATIVES, "rank")
    found = found.select(F.col("anchor").alias("of"), F.col("nth").alias("of_nth"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(chosen, (F.col("of") == F.col("anchor")) & (F.col("of_nth") == F.col("nth"))).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
