import hashlib
import math
import random

import numpy as np
import pytest

from corpusaudit.llm import centroids


def plain(rows, k, rounds, size, scale, seed):
    """Whole rounds over all vectors and all centroids, in Python integers."""
    kept = [
        (key, [math.floor(scale * x) for x in v])
        for key, v in rows
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda key: hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    order = sorted((name(key), v) for key, v in kept)
    centers = [list(v) for _, v in order[:k]]

    def assign():
        out = []
        for key, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centers]
            out.append((key, d.index(min(d)), min(d), v))
        return out

    for _ in range(rounds):
        got = assign()
        for c in range(len(centers)):
            mine = [v for _, a, _, v in got if a == c]
            if mine:
                centers[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return assign(), centers


@pytest.mark.parametrize(("k", "rounds", "spread"), [(8, 10, 1.0), (5, 3, 0.004), (40, 4, 2.0)])
def test_equals_whole_rounds(spark, k, rounds, spread):
    rng = random.Random(k)
    size = 6
    rows = [(i, [rng.choice([-1, 0, 1]) + rng.uniform(-spread, spread) for _ in range(size)]) for i in range(300)]
    rows += [(3, rows[3][1]), (7, rows[8][1]), (None, rows[9][1]), (400, rows[10][1])]
    odd = [(500, None), (501, []), (502, [1.0] * 5), (503, [1.0] * 7), (504, [1.0, None] + [0.0] * 4), (505, [float("nan")] * 6)]
    rows += [*odd, (506, [float("inf")] + [0.0] * 5)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, cluster int, _v int")
    got, centers, figures = centroids.clustered(table, k, rounds, size, 1024, "s")
    want, expected = plain(rows, k, rounds, size, 1024, "s")
    assert centers.tolist() == expected
    assert sorted(map(tuple, got.collect()), key=str) == sorted([w[:3] for w in want], key=str)
    full = centroids.with_figures(got, centers, figures).collect()
    for r in full:
        assert r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster)
        assert r.inertia == sum(w[2] for w in want)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, expected[r.cluster])).encode()).hexdigest()


def test_bounds_spare_distances_and_lose_none():
    rng = np.random.default_rng(2)
    middle = rng.integers(-4000, 4000, (20, 64))
    v = middle[rng.integers(0, 20, 5000)] + rng.integers(-300, 300, (5000, 64))
    pivots = centroids.spread_pivots(v[:200], 12)
    far = np.sqrt(np.stack([centroids._squared(v, p) for p in pivots], axis=1).astype(float))
    which, best, measured = centroids.nearest(v, far, middle, pivots)
    d = np.stack([centroids._squared(v, c) for c in middle], axis=1)
    assert (which == d.argmin(1)).all() and (best == d.min(1)).all()
    assert measured < 0.5 * d.size


def test_ties_go_to_the_smaller_number():
    v = np.array([[0, 0], [5, 5]])
    c = np.array([[9, 9], [1, 0], [0, 1], [-1, 0]])
    p = v[:1]
    far = np.sqrt(np.stack([centroids._squared(v, x) for x in p], axis=1).astype(float))
    which, best, _ = centroids.nearest(v, far, c, p)
    assert which.tolist() == [1, 0] and best.tolist() == [1, 32]


def test_few_none_and_huge_vectors(spark):
    table = spark.createDataFrame([(2, [0.5, 0.25]), (1, [0.5, 0.25])], "vec_id long, embedding array<float>")
    got, centers, figures = centroids.clustered(table, 8, 2, 2)
    assert len(centers) == 2 and {(r.vec_id, r.cluster, r.distance) for r in got.collect()} == {(1, 0, 0), (2, 0, 0)}
    got, centers, figures = centroids.clustered(table.limit(0), 8, 2, 2)
    full = centroids.with_figures(got, centers, figures)
    assert full.collect() == [] and full.columns[-1] == "centroid_sha256"
    table = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="after scaling"):
        centroids.clustered(table, 8, 2, 2)[0].collect()


def test_string_keys(spark):
    table = spark.createDataFrame([(f"v{i}", [float(i), 1.0]) for i in range(30)], "name string, v array<double>")
    got, centers, _ = centroids.clustered(table, 3, 4, 2, 1, "3", "name", "v")
    want, expected = plain([(f"v{i}", [float(i), 1.0]) for i in range(30)], 3, 4, 2, 1, "3")
    assert centers.tolist() == expected and got.count() == 30
