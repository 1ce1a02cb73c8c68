"""Hard negatives against all pairs in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import negatives

VECTORS = "vec_id long, embedding array<double>, label int"


def mined_by_hand(rows, every=100):
    fine = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    for a, (i, v, label) in enumerate(fine):
        if i is None or i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j is None, j or 0, l, b) for b, (j, w, l) in enumerate(fine) if len(w) == len(v) and b != a]
        same = sorted(x for x in scored if x[3] == label)[:5]
        other = sorted(x for x in scored if x[3] != label)
        for p, none, j, _, _ in same:
            hard = [x for x in other if 80 * -p <= 100 * -x[0] <= 100 * -p][:5]
            out += [(i, None if none else j, r + 1, None if x[1] else x[2], -p, -x[0]) for r, x in enumerate(hard)]
    return sorted(out, key=repr)


def mined_by_operator(df, **more):
    return sorted(map(tuple, negatives.hard_negatives(df, **more).collect()), key=repr)


def test_negatives_of_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    assert mined_by_operator(df) == mined_by_hand(rows)
    assert mined_by_operator(df, every=9) == mined_by_hand(rows, every=9)


@pytest.mark.parametrize("seed, size", [(1, 40), (2, 3), (3, 12)])
def test_negatives_in_small_tiles_and_blocks(spark, monkeypatch, seed, size):
    """Clusters, ties and copies, dealt over many blocks, tiles and chunks."""
    for name, value in (("TILE", 7), ("CHUNK", 16), ("BLOCK", 2000)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, size))
    rows = []
    for i in range(300):
        v = centres[i % 4] if i % 3 == 0 else np.round(centres[i % 4] + rng.normal(size=size) * 0.3, 1)
        rows.append((int(rng.integers(0, 250)), [float(x) for x in v], int(rng.integers(0, 3))))
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    assert mined_by_operator(df, every=5) == mined_by_hand(rows, every=5)


def test_a_third_of_all_rows_in_one_vector(spark):
    rng = random.Random(5)
    rows = [(i, [0.5, 0.5, 0.0] if i % 3 == 0 else [rng.random(), rng.random(), rng.random()], i % 4) for i in range(3000)]
    assert mined_by_operator(spark.createDataFrame(rows, VECTORS).repartition(4)) == mined_by_hand(rows)


def test_negatives_on_awkward_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5], 1), (100, [0.4, 0.6], 2), (1, [0.5, 0.4], 2), (2, [0.5, 0.4], 2), (3, None, 2), (4, [None, 1.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (8, [0.5, 0.5], None)]
    rows += [(0, [0.5, 0.5], 1), (None, [0.5, 0.45], 1), (None, [0.5, 0.45], 2), (14, [0.5, 0.49], 9), (200, [], 1), (9, [], 1), (10, [], 3), (300, [0.0, 0.0], 1), (11, [1.0], 1), (400, [-0.5, -0.5], 1)]
    rows += [(500, [1e9, 1e9, 0.0], 1), (501, [1e9, 2e9, 0.0], 1), (502, [1e9, 1.7e9, 1.0], 2), (503, [1e9, 1.7e9, -1.0], 2)]
    df = spark.createDataFrame(rows, VECTORS)
    clashing = df.withColumns({c: F.lit("x") for c in "rid score nth rank anchor pack block of of_nth scores d n".split()})
    small = [r for r in rows if len(r[1] or []) < 3]
    assert mined_by_operator(df) == mined_by_operator(clashing)
    assert [r for r in mined_by_operator(df) if r[0] != 500] == mined_by_hand(small)
    assert mined_by_operator(df.limit(0)) == [] and mined_by_operator(df.where("vec_id = 1")) == []


def test_products_beyond_64_bits_are_held_at_their_ends(spark):
    top = (1 << 63) - 1
    rows = [(0, [1e300, 1e308], 1), (1, [1e300, 1e308], 1), (2, [1e308, 1e300], 2), (3, [-1e308, 0.0], 2)]
    assert mined_by_operator(spark.createDataFrame(rows, VECTORS)) == [(0, 2, 1, 1, top, top)]  # the anchor, a multiple of 7, has label 2


def test_bounds_never_discard_a_pair_that_counts():
    """However poor the axes and the numbers, what lies in the interval survives."""
    for seed in range(40):
        rng = np.random.default_rng(seed)
        d = int(rng.integers(1, 70))
        scale = 10.0 ** rng.integers(-2, 6)
        x, y = (np.floor(256 * scale * (rng.normal(size=(n, d)) * rng.random(d) ** 4)) for n in (20, 50))
        axes, _ = np.linalg.qr(rng.normal(size=(d, min(d, 32))))
        a, b = negatives.Rotated(x, axes), negatives.Rotated(y, axes)
        exact = x.astype(object) @ y.astype(object).T
        low = np.array([float(sorted(r)[-3]) for r in exact])
        high = np.array([float(sorted(r)[-2]) for r in exact])
        i, j, p = negatives.survivors(a, slice(0, 20), b, slice(0, 50), low, high, np.ones((20, 50), dtype=bool))
        assert all(exact[m, n] == v for m, n, v in zip(i, j, p.tolist()))
        inside = {(m, n) for m in range(20) for n in range(50) if low[m] <= exact[m, n] <= high[m]}
        assert inside <= set(zip(i.tolist(), j.tolist()))


def test_most_pairs_are_discarded_by_their_leading_components(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x = negatives.whole(np.stack(rows.embedding.to_numpy()).astype(np.float64))
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :56]
    a = negatives.Rotated(x, axes)
    exact = x @ x.T
    low = np.sort(exact, axis=1)[:, -6]
    i, _, _ = negatives.survivors(a, slice(0, len(x)), a, slice(0, len(x)), low, np.full(len(x), np.inf), np.ones(exact.shape, dtype=bool))
    assert len(i) < 0.1 * exact.size
