import math
import random

import numpy as np

from candrank.llm.neighbours import IndexParams, balanced_centroids, distinct_vectors, linked, nearest, nearest_in_block, routed, search, squared, usable, within
from candrank.llm.registry import QUERIES
from tests.conftest import DATA

#: Small lists and blocks, so that all of the method is used on few rows.
SMALL = IndexParams(k=5, list_size=8, lists=32, sample=400, beam=2, degree=4, calibration=40, posting_block=16, query_block=2)


def plain(rows, every, k):
    """{query: [(score, vec_id) by rank]} by brute force over lists."""
    good = sorted({(i, tuple(0.0 + float(c) for c in v)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)})
    apart = lambda a, b: float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum()))
    return {i: sorted({(apart(q, v), j) for j, v in good if j != i and len(v) == len(q)})[:k] for i, q in good if i % every == 0}


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], "vec_id long, embedding array<double>, a int, lists string, score double")


def rows_of(seed, n=400, dim=6):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    rows = [(i, [c + rnd.gauss(0, 0.4) for c in rnd.choice(centres)]) for i in range(n)]
    rows += [(i, rows[40][1]) for i in range(n, n + n // 2)]  # a third of all are one vector
    rows += [(20, rows[20][1]), (9000, None), (9020, []), (9040, [float("nan")] * dim), (9060, [None] + [0.1] * (dim - 1)), (9080, [0.0] * dim), (9100, [-0.0] * dim), (9120, [float("inf")] + [0.0] * (dim - 1)), (None, [0.1] * dim)]
    return rows + [(9140, [1.0, 2.0]), (9141, [1.0, 3.0]), (9142, [1.0, 1.0]), (9160, [5.0])]


def test_many_small_lists_find_most(spark):
    rows = rows_of(13)
    want = plain(rows, 20, SMALL.k)
    found = nearest(frame(spark, rows).repartition(3), 20, SMALL).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    assert {i for i, v in want.items() if v} == set(got) and {i: len(v) for i, v in got.items()} == {i: len(v) for i, v in want.items() if v}
    exact = {i: dict((j, s) for s, j in v) for i, v in plain(rows, 20, 10**6).items()}
    assert all(exact[i][j] == s for i, v in got.items() for s, j in v) and all(v == sorted(v) for v in got.values())
    # Vectors as far as the last count as found: so many are equal here.
    hit = sum(s <= want[i][-1][0] for i, v in got.items() for s, _ in v)
    assert hit >= 0.9 * sum(map(len, want.values()))
    assert got[9140] == want[9140]


def test_lists_of_all_rows_are_exact(spark):
    rows = rows_of(7, 150)
    p = IndexParams(k=7, list_size=20, target=1.0, boundary=100.0, replicas=1000, posting_block=30, query_block=3)
    got = {}
    for r in nearest(frame(spark, rows), 10, p).collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert {i: sorted(v) for i, v in got.items()} == {i: v for i, v in plain(rows, 10, 7).items() if v}


def test_few_or_no_candidates(spark):
    some = frame(spark, [(100, [1.0, 0.0]), (101, [0.0, 1.0]), (200, [1.0, 0.0])])
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(some, 100).collect())
    assert got == [(100, 1, 200, 0.0), (100, 2, 101, math.sqrt(2)), (200, 1, 100, 0.0), (200, 2, 101, math.sqrt(2))]
    assert not nearest(frame(spark, [(100, [1.0, 0.0]), (101, None)]), 100).collect()
    assert not nearest(frame(spark, [(100, None)]), 100).collect()


def test_query_recall_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want = plain(rows, 100, 10)
    got = QUERIES["op13_nearest_neighbours"](spark, DATA).collect()
    assert {(r.query_id, r.rank) for r in got} == {(i, n + 1) for i, v in want.items() for n in range(len(v))}
    assert sum((r.score, r.vec_id) in want[r.query_id] for r in got) >= 0.9 * sum(map(len, want.values()))


def test_graph_finds_the_nearest_centroids():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(4000, 8)) + 8 * rnd.normal(size=(10, 8))[rnd.integers(0, 10, 4000)]  # islands
    c = balanced_centroids(x, 256)
    sizes = np.bincount(squared(x, c).argmin(axis=1), minlength=len(c))
    assert len(c) == 256 and np.percentile(sizes, 95) < 4 * 4000 / 256
    index = linked(c, 12)
    ids, d = search(index, x[:500], 16)
    want = squared(x[:500], c)
    assert (np.diff(d, axis=1) >= 0).all() and np.allclose(np.take_along_axis(want, ids, axis=1), d)
    assert (ids[:, 0] == want.argmin(axis=1)).mean() > 0.98
    true = np.argsort(want, axis=1)[:, :8]
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(ids.tolist(), true.tolist())]) > 0.95
    lists = [set(ids.tolist()) for ids, _ in within(index, x[:200], 1.5, 16)]
    every = [set(np.flatnonzero(np.sqrt(w) <= 1.5 * np.sqrt(w.min())).tolist()) for w in want[:200]]
    assert all(a <= b | {next(iter(a))} for a, b in zip(lists, every)) and sum(map(len, lists)) >= 0.95 * sum(map(len, every))


def test_boundary_vectors_are_in_several_lists_and_hot_vectors_are_one_row(spark):
    vectors = usable(frame(spark, rows_of(5)))
    different = distinct_vectors(vectors, SMALL.k)
    hot = different.where("size(ids) > 1").collect()
    assert [list(r.ids) for r in hot] == [[40, 400, 401, 402, 403, 404]]
    c = np.array([[0.0] * 6, [1.0] * 6, [9.0] * 6])
    indexes = {6: linked(c, 2), 2: linked(np.zeros((1, 2)), 2), 1: linked(np.zeros((1, 1)), 2)}
    for r in routed(different, indexes, IndexParams(replicas=2, boundary=1.5)).where("dim = 6").collect():
        d = np.sqrt(((np.array(r.v) - c) ** 2).sum(axis=1))
        assert r.lists == [i for i in np.argsort(d)[:2] if d[i] <= 1.5 * d.min()]


def test_blocks_keep_ties_by_the_least_id():
    q, x = np.array([[0.0, 0.0]]), np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [3.0, 0.0]])
    i, j, d = nearest_in_block(q, x, np.array([9, 4, 5, 1]), 1)
    assert j.tolist() == [1, 2] and d.tolist() == [1.0, 1.0]
