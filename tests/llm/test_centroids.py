import hashlib
import math
import random

import numpy as np
import pytest

from candrank.llm.centroids import ClusterParams, cluster, nearest, principal_axes, rotated, whole_vectors
from candrank.llm.registry import ORACLE_SQL, QUERIES


def test_query_equals_its_sql(same):
    same(QUERIES["op11_centroid_clusters"], ORACLE_SQL["op11_centroid_clusters"])


def plain(rows, p):
    """(sorted (vec_id, cluster, distance), centroids) by lists and whole numbers alone."""
    kept = [(i, [math.floor(float(c) * p.scale) for c in v]) for i, v in rows if i is not None and v and len(v) == p.dim and all(c is not None and math.isfinite(c) for c in v)]
    key = lambda x: (hashlib.sha256(f"{p.seed}:{x[0]}".encode()).hexdigest(), x[1])
    centroids = [v for _, v in sorted(kept, key=key)[: p.k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((apart(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]
    for _ in range(p.rounds):
        held = {}
        for (_, v), (_, n) in zip(kept, assign()):
            held.setdefault(n, []).append(v)
        centroids = [[sum(x) // len(held[n]) for x in zip(*held[n])] if n in held else c for n, c in enumerate(centroids)]
    return sorted((i, n, d) for (i, _), (d, n) in zip(kept, assign())), centroids


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, [2], "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, v array<int>, lead string")


def test_rounds_equal_plain_lists(spark):
    rnd = random.Random(11)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [c + rnd.gauss(0, 0.3) for c in rnd.choice(centres)]) for i in range(240)]
    rows += [(i, rows[0][1]) for i in range(300, 420)]  # a third of all are one vector
    rows += [(7, rows[3][1]), (7, [0.0] * 6)]  # a repeated vec_id
    rows += [(500, None), (501, []), (502, [float("nan")] * 6), (503, [None] + [0.1] * 5), (504, [float("-inf")] + [0.0] * 5), (None, [0.1] * 6), (505, [1.0] * 7)]
    for p in (ClusterParams(dim=6, k=9, leading=2), ClusterParams(dim=6, k=5, leading=6, rounds=0), ClusterParams(dim=6, k=1000, leading=3, rounds=2)):
        found, centroids = cluster(whole_vectors(frame(spark, rows), p.dim, p.scale), p)
        want, centres_ = plain(rows, p)
        assert sorted(map(tuple, found.collect())) == want
        assert centroids.tolist() == centres_


def test_ties_go_to_the_smaller_number():
    x = np.zeros((3, 2), dtype=np.int64)
    c = np.array([[0, 5], [3, 4], [5, 0], [9, 9]])
    turn = lambda a: rotated(a, np.zeros(2), np.eye(2), 1)
    n, d, _ = nearest(x, *turn(x), c, *turn(c))
    assert list(n) == [0, 0, 0] and list(d) == [25, 25, 25]


def test_large_components_stay_exact_or_fail(spark):
    p = ClusterParams(dim=2, k=2, rounds=1, leading=1, scale=1)
    rows = [(1, [2.0**30, 1.0]), (2, [2.0**30, 3.0]), (3, [2.0**30 + 1, 3.0]), (4, [0.0, 0.0])]
    found, _ = cluster(whole_vectors(frame(spark, rows), 2, 1), p)
    assert sorted(map(tuple, found.collect())) == plain(rows, p)[0]
    with pytest.raises(Exception, match="too large|int|Overflow"):
        cluster(whole_vectors(frame(spark, [(1, [2.0**70, 1.0])]), 2, 1), p)
    with pytest.raises(Exception, match="int|Overflow|overflow"):
        cluster(whole_vectors(frame(spark, [(1, [2.0**40, 1.0]), (2, [-(2.0**40), 1.0]), (3, [0.0, 0.0])]), 2, 1), ClusterParams(dim=2, k=1, rounds=0, leading=1, scale=1))[0].collect()


def test_an_empty_table_gives_no_row(spark):
    found, centroids = cluster(whole_vectors(frame(spark, [(1, None)]), 6, 256), ClusterParams(dim=6))
    assert found.columns == ["vec_id", "cluster", "distance"] and not found.collect() and not len(centroids)


def test_bounds_leave_most_centroids_uncomputed(spark):
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(40, 64))
    rows = [(i, (centres[i % 40] + 0.3 * rnd.normal(size=64)).tolist()) for i in range(2000)]
    v = whole_vectors(frame(spark, rows), 64, 256)
    mean, axes = principal_axes(v, 64)
    x = np.floor(256 * np.array([r for _, r in rows])).astype(np.int64)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(axes.T @ axes, np.eye(64))
    c = np.floor(256 * centres).astype(np.int64)
    n, d, computed = nearest(x, *rotated(x, mean, axes, 16), c, *rotated(c, mean, axes, 16))
    exact = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    assert (n == exact.argmin(axis=1)).all() and (d == exact.min(axis=1)).all()
    assert computed < 0.2 * exact.size
