"""Clusters against distances to every centroid."""

import hashlib
import math
import random

import numpy as np
import pytest

from tallyspark.llm import centroids


def by_hand(rows, k, rounds, dims, scale):
    own = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted((x for x in own if x[0] is not None), key=lambda x: (hashlib.sha256(f"1:{x[0]}".encode()).hexdigest(), x[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in own]
        groups = [[v for (_, v), o in zip(own, of, strict=True) if o == j] for j in range(len(c))]
        c = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else old for g, old in zip(groups, c, strict=True)]
    found = [(i, *near(v)) for i, v in own]
    inertia = {j: sum(d for _, d, o in found if o == j) for j in range(len(c))}
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found), key=repr)


@pytest.mark.parametrize("size", [1.0, 1e6, 1e15])
def test_clusters(spark, size):
    r = random.Random(3)
    rows = [(i, [round(r.gauss(i % 4, 0.7), 1) * size for _ in range(6)]) for i in range(150)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (0, rows[0][1]), (203, None), (204, []), (205, [1.0] * 5), (206, [1.0] * 5 + [None]), (207, [math.nan] * 6), (208, [math.inf] * 6), (None, [0.5] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = centroids.cluster(table, k=5, rounds=3, dims=6, scale=64).select("vec_id", *centroids.ADDED).collect()
    want = by_hand(rows, 5, 3, 6, 64)
    fits = lambda x: x if x < 1 << 63 else None
    assert sorted(map(tuple, got), key=repr) == sorted(((i, j, fits(d), fits(n), fits(t), h) for i, j, d, n, t, h in want), key=repr)


def test_zero_favours_the_smaller_number():
    t = centroids.Tournament([[0, 0], [2, 0], [0, 2], [2, 0]])
    of, distance = t.nearest(np.array([[1, 0], [1, 1], [2, 0], [5, 5], [0, 3]]))
    assert (of.tolist(), distance) == ([0, 0, 1, 1, 2], [1, 2, 0, 34, 1])
    large = centroids.Tournament([[x << 40 for x in c] for c in ([0, 0], [2, 0], [0, 2], [2, 0])])
    assert large.nearest(np.array([[1, 0], [1, 1], [2, 0], [5, 5], [0, 3]]) << 40)[0].tolist() == [0, 0, 1, 1, 2]


def test_odd_tables(spark):
    few = spark.createDataFrame([(None, [1.0, 2.0], "x", 7), (None, [1.0, 2.0], "x", 7)], "vec_id long, embedding array<float>, `a.b` string, cluster int")
    got = centroids.cluster(few, dims=2)
    assert [(r["a.b"], r.cluster, r.distance, r.inertia) for r in got.collect()] == [("x", 0, 0, 0)] * 2
    assert centroids.cluster(few.limit(0), dims=2).collect() == []
    assert centroids.cluster(few, dims=3).collect() == []
