"""The distance join where cells are crowded."""

import random

import numpy as np

from candrank.operators import docking
from candrank.operators.docking import dealt_cells, neighbourhoods, within


def frame(spark, rows):
    return spark.createDataFrame(rows, "system string, i int, x double, y double, z double").repartition(4)


def cloud(seed, n, half):
    """Half of all rows in one cell, a part of those at one and the same spot."""
    rnd = random.Random(seed)
    rows = [(rnd.choice("st"), k, *(rnd.uniform(-20, 20) for _ in range(3))) for k in range(n - half)]
    spot = [rnd.uniform(0.05, 0.95) * 4 for _ in range(3)]
    return rows + [("s", n - half + k, *(spot if k % 4 == 0 else (rnd.uniform(0, 4) for _ in range(3)))) for k in range(half)]


def plain(a, b, radius):
    x, y = (np.array([r[2:] for r in rows]) for rows in (a, b))
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    return sorted((a[i][1], b[j][1]) for i, j in zip(*np.nonzero(d <= radius)) if a[i][0] == b[j][0])


def test_crowded_cells_give_the_same_rows(spark):
    a, b = cloud(1, 260, 130), cloud(2, 300, 150)
    want = plain(a, b, 4.0)
    for crowded in (1, 10, 40, 20_000):
        got = sorted((r.a.i, r.b.i) for r in within(frame(spark, a), frame(spark, b), ["system"], 4.0, crowded).select("a", "b").collect())
        assert got == want, crowded
    edge = [("s", k, 4.0 * x, 4.0 * y, 0.0) for k, (x, y) in enumerate([(0, 0), (1, 0), (0.5, 0), (-1, 0), (1, 1), (0.25, 0.75)])]  # on borders, at the radius exactly
    assert sorted((r.a.i, r.b.i) for r in within(frame(spark, edge), frame(spark, edge), ["system"], 4.0, 1).select("a", "b").collect()) == plain(edge, edge, 4.0)
    assert not within(frame(spark, a), frame(spark, b[:0]), ["system"], 4.0, 1).collect()


def test_no_key_is_much_over_the_bound(spark):
    a, b = cloud(3, 6_000, 3_000), cloud(4, 6_000, 3_000)
    left, right, keys = dealt_cells(frame(spark, a), frame(spark, b), ["system"], 4.0, 200)
    for side in (left, right):
        assert max(r["count"] for r in side.groupBy(*keys).count().collect()) <= 200 * 1.5
    # Halving spares comparisons: fewer pairs meet than in the cells as they are.
    pairs = left.join(right, keys).count()
    cells = [tuple(int(np.floor(v / 4.0)) for v in r[2:]) + (r[0],) for r in b]
    held = {c: cells.count(c) for c in set(cells)}
    plain_pairs = sum(held.get((cx + x, cy + y, cz + z, r[0]), 0) for r in a for cx, cy, cz in [tuple(int(np.floor(v / 4.0)) for v in r[2:])] for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1))
    assert pairs < plain_pairs


def test_neighbourhoods_are_those_of_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(docking, "BLOCK", 50)
    a, b = cloud(5, 260, 130), cloud(6, 300, 150)
    edge = [("s", k, 4.0 * x, 4.0 * y, 0.0) for k, (x, y) in enumerate([(0, 0), (1, 0), (0.5, 0), (-1, 0), (1, 1), (0.25, 0.75)])]
    for left, right, radius in ((a, b, 4.0), (edge, edge, 4.0), (a, b, 30.0), (a, b, 0.3)):
        system, at = {r[1]: r[0] for r in left}, [np.array([r[2:] for r in rows]) for rows in (left, right)]
        want = {}
        for i, j in plain(left, right, radius):
            want.setdefault((system[i], i), []).append((j, float(np.sqrt(((at[0][i] - at[1][j]) ** 2).sum()))))
        for crowded in (1, 7, 64):
            got = {(r.system, r.i): (r.n, r.total, r.farthest) for r in neighbourhoods(frame(spark, left), frame(spark, right), ["system"], radius, "i", "i", crowded).collect()}
            assert got == {k: (len(x), sum(j for j, _ in x), max(d for _, d in x)) for k, x in want.items()}, (radius, crowded)


def test_tiles_spare_comparisons():
    """One spot within the radius as a whole: few pairs are compared, and the counts, sums and farthest distances are those of all pairs."""
    rnd = np.random.default_rng(7)
    a, b, ids = rnd.normal(0, 0.05, (1_000, 3)), rnd.normal(0, 0.05, (2_000, 3)), rnd.integers(-50, 1 << 40, 2_000)
    order, starts, low, high = docking._tiles(b, 64)
    assert sorted(order) == list(range(2_000)) and len(starts) == 32 and (high - low).prod(axis=1).mean() < 0.2 * (b.max(axis=0) - b.min(axis=0)).prod()
    n, total, far = docking._around_each(a, b, ids, 0.75**2, 64)
    d = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    assert (n == 2_000).all() and (total == ids.sum()).all() and np.allclose(far, d.max(axis=1), rtol=1e-12)
