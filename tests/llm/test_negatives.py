"""Hard negatives against brute force; the tree's structure and what it leaves out."""

import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voicegrid.llm import hard_negatives
from voicegrid.llm.cover_tree import LOWEST, Search, build, load
from voicegrid.llm.hard_negatives import mine


def brute(rows, positives=5, negatives=10, low=30, high=90):
    """Rows of (id, label, whole-number vector); anchors have ids divisible by 100."""
    out = set()
    for a, label, vector in {(i, l, tuple(v)) for i, l, v in rows if i is not None and i % 100 == 0}:
        scored = []
        for i, l, v in rows:
            if i != a:
                scored.append((-sum(int(x) * int(y) for x, y in zip(vector, v)), i if i is not None else 1 << 63, i, l))
        scored.sort(key=lambda x: x[:2])
        for minus, _, p, _ in [x for x in scored if x[3] == label][:positives]:
            held = [x for x in scored if x[3] != label and low * -minus <= 100 * -x[0] <= high * -minus][:negatives]
            out |= {(a, p, k + 1, x[2], -minus, -x[0]) for k, x in enumerate(held)}
    return out


def found_by(df):
    return {tuple(row) for row in df.collect()}


def clustered(rng, n, dim, ties):
    centers = rng.integers(-90, 90, (12, dim))
    vectors = centers[rng.integers(0, 12, n)] + rng.integers(-25, 25, (n, dim))
    if ties:
        vectors[rng.random(n) < 0.35] = centers[0]
    return vectors


@pytest.mark.parametrize(("n", "dim", "ties", "spread"), [(1500, 8, True, False), (1500, 3, False, False), (900, 24, False, True)])
def test_brute_force(spark, monkeypatch, n, dim, ties, spread):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 400)
    monkeypatch.setattr(hard_negatives, "BLOCK", 4)
    rng = np.random.default_rng(n + dim)
    vectors = rng.integers(-90, 90, (n, dim)) if spread else clustered(rng, n, dim, ties)
    rows = [(int(k), int(rng.integers(0, 4)), v.tolist()) for k, v in enumerate(vectors)]
    df = spark.createDataFrame([(i, l, [x / 256 for x in v]) for i, l, v in rows], "vec_id long, label int, embedding array<float>")
    assert found_by(mine(df, F.col("id") % 100 == 0)) == brute(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (100, 1, [0.5, 0.5]), (100, 1, [0.5, 0.5]), (200, 1, None), (300, None, [0.1]), (400, 1, [nan, 1.0]), (500, 1, [1.0, inf]),
        (600, 1, [None, 1.0]), (None, 1, [0.5, 0.25]), (None, 2, [0.25, 0.25]), (7, 2, [0.25]), (8, 2, [0.25, 0.125, 9.0]), (8, 2, [0.25, 0.125, 9.0]),
        (9, 1, []), (700, 3, [-1.0, -1.0]), (800, 2, [1e30, -1e30]), (1, 1, [0.5, 0.5]), (2, 1, [0.5, 0.5]),
    ]
    df = spark.createDataFrame([(*row, "x", 1, 2.0) for row in rows], "vec_id long, label int, embedding array<double>, id string, rank int, score double")
    whole = lambda x: max(-(1 << 26), min(1 << 26, int(np.floor(x * 256))))
    usable = [(i, l, list(map(whole, v))) for i, l, v in rows if l is not None and v is not None and None not in v and np.isfinite(v).all()]
    found = found_by(mine(df, F.col("id") % 100 == 0))
    assert found == brute(usable) and any(None in row for row in found)
    assert mine(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_tree_leaves_out_far_nodes():
    rng = np.random.default_rng(3)
    vectors = clustered(rng, 20_000, 6, False).astype(np.int32)
    ids, labels = np.arange(20_000), np.zeros(20_000, np.int64)
    tree = load(io.BytesIO(build(ids, labels, vectors)))
    assert sorted(tree.ids) == list(range(20_000)) and len(tree.first) > 50
    for node in range(len(tree.first)):
        inside = tree.rows(tree.first[node], tree.last[node]).astype(float)
        rise = lambda x: np.concatenate([x, np.sqrt(np.maximum(tree.norm**2 - (x**2).sum(1), 0))[:, None]], 1)
        assert np.sqrt(((rise(inside) - rise(tree.centers[node : node + 1])) ** 2).sum(1)).max() <= tree.radius[node] + 1e-6
    queries = vectors[:20]
    open_window = np.full((20, 1), LOWEST)
    search = Search(ids[:20], np.ones(20, np.int64), queries, open_window, -open_window, 7, False)
    search.add(tree)
    products = queries.astype(np.int64) @ vectors.T.astype(np.int64)
    products[np.arange(20), np.arange(20)] = LOWEST
    assert sorted(search.found[2]) == sorted(np.sort(products, 1)[:, -7:].ravel())
    assert search.visited < 0.5 * 20 * 20_000


def test_large_components_stay_exact():
    random.seed(1)
    vectors = np.array([[random.choice((-1, 1)) * (2**26 - random.randint(0, 9)) for _ in range(16)] for _ in range(700)], np.int32)
    search = Search(np.array([-1]), np.array([0]), vectors[:1], np.full((1, 1), LOWEST), np.full((1, 1), -LOWEST), 700, False)
    search.add(load(io.BytesIO(build(np.arange(700), np.ones(700, np.int64), vectors))))
    wanted = sorted(sum(int(a) * int(b) for a, b in zip(vectors[0], v)) for v in vectors)
    assert sorted(search.found[2].tolist()) == wanted
