import math
import random

import numpy as np
import pytest

from candrank.llm.registry import ORACLE_SQL, QUERIES
from candrank.llm.topk import best, grid, kind_for, top_k


def test_query_equals_its_sql(same):
    same(QUERIES["op4_topk"], ORACLE_SQL["op4_topk"])


def plain(vectors, k, every):
    g = [(i, [math.floor(64 * float(c)) for c in v]) for i, v in vectors if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, q in (x for x in g if x[0] % every == 0):
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in g if j != i and len(v) == len(q))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def test_blocks_bounds_ties_and_bad_vectors(spark):
    rnd = random.Random(3)
    data = [(i, [rnd.choice([-0.5, -0.02, 0.0, 0.3, rnd.gauss(0, 0.2)]) for _ in range(6)]) for i in range(300)]
    data += [(300, None), (301, []), (302, [float("nan")] * 6), (303, [None] * 6), (304, [float("inf")] + [0.0] * 5), (None, [0.1] * 6), (320, [1.0, 2.0]), (321, [1.0, 1.0]), (340, [9.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in data], "vec_id long, embedding array<double>, dim int, v string")
    v = grid(df)
    for blocks in ((7, 40), (2048, 8192)):
        got = top_k(v.where("vec_id % 20 = 0"), v, 5, *blocks)
        assert sorted(map(tuple, got.collect())) == plain(data, 5, 20)
    empty = grid(df.limit(0))
    assert top_k(empty, empty).count() == 0


def test_large_components_stay_exact():
    x = np.array([[2**30, 1], [2**30, 2], [5, 5]], dtype=np.int64)
    q, i, s, _ = best(x[:1], np.array([0]), x, np.array([0, 1, 2]), 2)
    assert list(i) == [1, 2] and list(s) == [2**60 + 2, 5 * 2**30 + 5]


def test_sums_beyond_a_long_are_exact_or_fail():
    x = np.array([[2**40, 2**40], [2**40, -(2**40)], [1, 2]], dtype=np.int64)
    assert kind_for(2**81) is object
    q, i, s, _ = best(np.array([[2**22, 0]], dtype=np.int64), np.array([9]), x, np.array([0, 1, 2]), 3)
    assert list(i) == [0, 1, 2] and list(s) == [2**62, 2**62, 2**22]
    with pytest.raises(OverflowError):
        best(x[:1], np.array([9]), x, np.array([0, 1, 2]), 3)


def test_bounds_leave_most_vectors_unscored():
    rnd = np.random.default_rng(5)
    x = np.floor(8 * rnd.normal(size=(16_384, 64))).astype(np.int64)
    ids, want = np.arange(len(x)), x[:200] @ x.T
    q, i, s, scored = best(x[:200], ids[:200], x, ids, 20)
    assert scored < 0.35 * 200 * len(x)
    for k in range(200):
        order = np.lexsort((ids, -want[k]))
        order = order[order != k][:20]
        assert list(i[q == k]) == list(order) and list(s[q == k]) == list(want[k][order])
