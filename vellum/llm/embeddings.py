"""Near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, cut, stored

#: Leading principal dimensions whose grid cells order the vectors, and that bound distances.
LEADING = 7
#: Bytes of one interval's vectors, about, and vectors of the smaller ones within it.
INTERVAL, INNER = 2 << 20, 512
_FAN = 3  # an interval has 2 ** _FAN parts at the next level
#: A task joins two bands of the sequence, of 2 ** _BAND intervals each.
_BAND = 2
#: Passes over the vectors in which the axes are found, and axes carried along beside those that are kept.
_PASSES, _MORE = 3, 5
#: Cosines this near the threshold are summed again without rounding.
_NEAR = 1e-11


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _principal(reps: DataFrame, size: int, leading: int) -> np.ndarray:
    """Axes near the leading eigenvectors of the unit vectors' covariance, by subspace iteration from fixed random axes.

    Any orthogonal axes give bounds that hold, better ones rule out more. Each pass over all vectors gives the driver size * (axes + 1) + 1 sums.
    """
    width = min(size, leading + _MORE)
    axes, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(size, width)))
    for _ in range(_PASSES):

        def sums(batches: Iterator[pa.RecordBatch], axes: np.ndarray = axes) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size * width + size + 1)
            for batch in batches:
                if len(batch):
                    u = _unit(_matrix(batch.column("embedding")))
                    total += np.concatenate([(u.T @ (u @ axes)).ravel(), u.sum(axis=0), [len(u)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["k", "x"])

        total = np.zeros(size * width + size + 1)
        for r in reps.select("embedding").mapInArrow(sums, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
            total[r["k"]] = r["x"]
        n = max(total[-1], 1)
        mean = total[-1 - size : -1] / n
        axes, _ = np.linalg.qr(total[: size * width].reshape(size, width) / n - np.outer(mean, mean @ axes))
    return np.ascontiguousarray(axes[:, :leading])


def _placed(reps: DataFrame, axes: np.ndarray, epsilon: float) -> DataFrame:
    """reps with the grid cell on the leading dimensions, most significant first, and the place on the first."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _unit(_matrix(batch.column("embedding"))) @ axes if len(batch) else np.zeros((0, axes.shape[1]))
            cells = np.clip(np.floor((y + 1) / epsilon), 0, 255).astype(np.int64)
            key = np.zeros(len(y), dtype=np.int64)
            for k in range(cells.shape[1]):
                key = key << 8 | cells[:, k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key), pa.array(np.ascontiguousarray(y[:, 0]) if len(y) else [], pa.float64())], names=[*batch.schema.names, "cell", "first"])

    return reps.mapInArrow(place, "rep long, n long, embedding array<double>, cell long, first double")


def _intervals(placed: DataFrame, axes: np.ndarray, size: int) -> DataFrame:
    """Intervals of the sorted sequence: their vectors, packed, and their bounds on the leading dimensions."""
    leading = axes.shape[1]
    most = max(64, INTERVAL // (8 * axes.shape[0]))
    fields = ", ".join(f"lo{k} double, hi{k} double" for k in range(leading))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, index = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def packed(rep: np.ndarray, n: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            nonlocal index
            y = _unit(x) @ axes
            bounds = [f for k in range(leading) for f in (y[:, k].min(), y[:, k].max())]
            row = [[part], [index], [rep.tobytes()], [n.tobytes()], [x.tobytes()], *([b] for b in bounds)]
            index += 1
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), *[pa.float64()] * len(bounds)]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=["part", "index", "reps", "counts", "vectors", *(f"{b}{k}" for k in range(leading) for b in ("lo", "hi"))])

        def joined() -> tuple[np.ndarray, ...]:
            return tuple(np.concatenate(x) for x in zip(*held, strict=True))

        for batch in batches:
            if not len(batch):
                continue
            held.append((batch.column("rep").to_numpy(), batch.column("n").to_numpy(), _matrix(batch.column("embedding"))))
            if sum(len(h[0]) for h in held) >= most:
                rep, n, x = joined()
                whole = len(rep) // most * most
                for a in range(0, whole, most):
                    yield packed(rep[a : a + most], n[a : a + most], x[a : a + most])
                held[:] = [(rep[whole:], n[whole:], x[whole:])] if whole < len(rep) else []
        if held:
            yield packed(*joined())

    # Distinct vectors that share a cell are ordered by their first principal coordinate, so a
    # crowded cell is dealt over as many partitions as its vectors fill.
    parts = max(1, math.ceil(size / (2 * most)))
    ordered = placed.repartitionByRange(parts, "cell", "first").sortWithinPartitions("cell", "first")
    return ordered.select("rep", "n", "embedding").mapInArrow(pack, f"part long, index long, reps binary, counts binary, vectors binary, {fields}")


def _apart(leading: int, left: str, right: str):
    """The squared distance that the bounds of two intervals prove, at least."""
    gap = lambda k: F.greatest(F.lit(0.0), F.col(f"{left}lo{k}") - F.col(f"{right}hi{k}"), F.col(f"{right}lo{k}") - F.col(f"{left}hi{k}"))
    total = F.lit(0.0)
    for k in range(leading):
        total = total + gap(k) * gap(k)
    return total


def _pairs(intervals: DataFrame, leading: int, epsilon: float) -> DataFrame:
    """(a, b), a <= b: the pairs of intervals that no bound proves distant, found level by level from the whole sequence down."""
    bounds = [f"{b}{k}" for k in range(leading) for b in ("lo", "hi")]
    highest = intervals.agg(F.max("seq")).first()[0] or 0
    levels = math.ceil(int(highest).bit_length() / _FAN)
    narrow = cut(intervals.select("seq", *bounds))
    pairs = narrow.select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).limit(1)
    for level in range(levels - 1, -1, -1):
        node = F.shiftright("seq", _FAN * level)
        nodes = narrow.groupBy(node.alias("node")).agg(*((F.min if c[0] == "l" else F.max)(c).alias(c) for c in bounds)).withColumn("over", F.shiftright("node", _FAN))
        left = nodes.select(F.col("node").alias("na"), F.col("over").alias("a"), *(F.col(c).alias(f"a{c}") for c in bounds))
        right = nodes.select(F.col("node").alias("nb"), F.col("over").alias("b"), *(F.col(c).alias(f"b{c}") for c in bounds))
        pairs = pairs.join(left, "a").join(right, "b").where(F.col("na") <= F.col("nb")).where(_apart(leading, "a", "b") <= epsilon * epsilon + 1e-9)
        pairs = cut(pairs.select(F.col("na").alias("a"), F.col("nb").alias("b")))
    return pairs


class _Forest:
    """Union-find over the vectors of one pair of intervals."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return int(i)

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up


def _linked(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, least: float) -> np.ndarray:
    """Which rows of x and y have a cosine of `least` or more, in double precision."""
    dots = u @ v.T
    links = dots >= least
    for i, j in zip(*np.nonzero(np.abs(dots - least) < _NEAR), strict=True):
        a, b = x[i], y[j]
        links[i, j] = math.fsum(a * b) / (math.sqrt(math.fsum(a * a)) * math.sqrt(math.fsum(b * b))) >= least
    return links


def join_intervals(x: np.ndarray, y: np.ndarray | None, nx: np.ndarray, ny: np.ndarray | None, axes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each vector of x, then of y (copies counted), and the root of each in a spanning forest of the links.

    y None joins x with itself. Smaller intervals whose bounds prove them distant are skipped.
    """
    own = y is None
    y, ny = (x, nx) if own else (y, ny)
    u, v = _unit(x), _unit(y)
    pu, pv = u @ axes, v @ axes
    epsilon = 2 - 2 * least + 1e-9
    degree = np.zeros(len(x) + (0 if own else len(y)), dtype=np.int64)
    shift = 0 if own else len(x)
    forest = _Forest(len(degree))
    cuts = lambda n: [(a, min(n, a + INNER)) for a in range(0, n, INNER)]
    for a, b in cuts(len(x)):
        low, high = pu[a:b].min(axis=0), pu[a:b].max(axis=0)
        for c, d in cuts(len(y)):
            if own and c < a:
                continue
            gap = np.maximum(0, np.maximum(low - pv[c:d].max(axis=0), pv[c:d].min(axis=0) - high))
            if (gap * gap).sum() > epsilon:
                continue
            links = _linked(x[a:b], y[c:d], u[a:b], v[c:d], least)
            if own and a == c:
                links = np.triu(links, 1)
            if not links.any():
                continue
            degree[a:b] += links @ ny[c:d]
            degree[shift + c : shift + d] += links.T @ nx[a:b]
            # Each round joins every row, and every column, to its first neighbour in another tree.
            while True:
                roots = forest.roots()
                open_ = links & (roots[a:b, None] != roots[None, shift + c : shift + d])
                rows, columns = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
                if not len(rows):
                    break
                for i, j in zip(rows.tolist(), open_[rows].argmax(axis=1).tolist(), strict=True):
                    forest.union(a + i, shift + c + j)
                for j, i in zip(columns.tolist(), open_[:, columns].argmax(axis=0).tolist(), strict=True):
                    forest.union(a + i, shift + c + j)
    return degree, forest.roots()


def _joined(pairs: DataFrame, intervals: DataFrame, axes: np.ndarray, least: float) -> DataFrame:
    """(rep, links, root): for each pair of intervals, its vectors that have links in it.

    Pairs are dealt by the bands of the sequence that their intervals lie in: a task gets each interval of two bands once, however
    many pairs it is in, and holds 2 ** (_BAND + 1) intervals at most.
    """
    width = axes.shape[0]
    bands = F.shiftright("a", _BAND).alias("band_a"), F.shiftright("b", _BAND).alias("band_b")
    dealt = cut(pairs.select(*bands, "a", "b"))
    wanted = dealt.select("band_a", "band_b", F.explode(F.array("a", "b")).alias("seq")).distinct()
    data = wanted.join(intervals.select("seq", "reps", "counts", "vectors"), "seq")

    def run(vectors: pa.Table, listed: pa.Table) -> pa.Table:
        held = {}
        for row in vectors.to_pylist():
            held[row["seq"]] = np.frombuffer(row["reps"], np.int64), np.frombuffer(row["counts"], np.int64), np.frombuffer(row["vectors"], np.float64).reshape(-1, width)
        out = []
        for a, b in zip(listed.column("a").to_pylist(), listed.column("b").to_pylist(), strict=True):
            (ids, counts, x), (ids2, counts2, y) = held[a], held[b]
            degree, root = join_intervals(x, None, counts, None, axes, least) if a == b else join_intervals(x, y, counts, counts2, axes, least)
            ids = ids if a == b else np.concatenate([ids, ids2])
            some = np.flatnonzero(degree)
            out.append((ids[some], degree[some], ids[root[some]]))
        return pa.table([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in (zip(*out, strict=True) if out else ((),) * 3)], names=["rep", "links", "root"])

    listed = dealt.select(F.col("band_a").alias("of_a"), F.col("band_b").alias("of_b"), "a", "b")
    return data.groupBy("band_a", "band_b").cogroup(listed.groupBy("of_a", "of_b")).applyInArrow(run, "rep long, links long, root long")


def near_duplicates(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding).

    Two rows are linked if the cosine of their vectors is `least` or more in double precision; a
    component holds what links reach, and its id is its smallest vec_id. Equal vectors become
    one before the join and are counted as often as they occur. Vectors are sorted by grid cells
    of the threshold's chord on the leading principal dimensions; the sequence is joined with
    itself, interval by interval, down to pairs of small intervals; intervals that the bounds on
    those dimensions prove distant are skipped, so no link is missed.

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing;
    vectors of different lengths don't link. Rows that repeat an id are vectors of their own; a
    null id is never a component's id unless all of its ids are null. An empty table gives no
    rows. Other columns are not read.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.coalesce(
        (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()).withColumn("fine", fine), "vectors")
    good = rows.where("fine")
    reps = stored(good.groupBy("embedding").agg(F.min("rid").alias("rep"), F.count("*").alias("n")).select("rep", "n", "embedding"), "distinct")
    found = []
    epsilon = math.sqrt(max(2 - 2 * least, 1e-12))
    sizes = reps.groupBy(F.size("embedding").alias("d")).count().collect()  # one row a vector length
    for d, count in sorted((r["d"], r["count"]) for r in sizes):
        own = reps.where(F.size("embedding") == d)
        axes = _principal(own, d, min(d, LEADING))
        intervals = stored(_intervals(_placed(own, axes, epsilon), axes, count), "intervals")
        bits = int(intervals.agg(F.max("index")).first()[0]).bit_length()
        intervals = intervals.withColumn("seq", F.shiftleft("part", bits) + F.col("index"))
        found.append(_joined(_pairs(intervals, axes.shape[1], epsilon), intervals, axes, least))
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    links = stored(links, "links")
    degree = links.groupBy("rep").agg(F.sum("links").alias("links"))
    trees = connected(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    known = reps.join(degree, "rep", "left").join(trees, "rep", "left").select("embedding", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    member = good.select("rid", "vec_id", "embedding").join(known, "embedding").select("vec_id", (F.col("links") + F.col("n") - 1).alias("n_links"), "component")
    member = stored(member, "members")
    named = member.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    out = member.join(named, "component").select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
