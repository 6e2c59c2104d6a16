"""Centroid clustering of whole-number vectors, filtered by leading rotated coordinates.

The vectors are rotated to their principal axes (from the moments of all vectors, one small sum for each task). A vector is
stored with its leading rotated coordinates and the norm of the rest. For a centroid kept the same way, the squared distance
of the leading coordinates plus the squared difference of the two norms is at most the squared distance of the vectors
(reverse triangle inequality in the rest). In each round a vector's distance to the centroid of least bound is computed in
whole numbers; only centroids whose bound does not exceed it survive, and are computed in whole numbers too. Bounds are
floating point with a margin far above its rounding, so they only ever save work: assignments, sums and means are exact.

Each round is one scan of the stored table. A task sends one row of sums for each centroid it met, so the shuffle has at most
tasks x centroids rows, however many vectors a cluster has. What goes through the driver is the moments and the centroids.

Defined results: vectors of another length than dim, null or with null or non-finite components, and rows without vec_id,
take no part; a repeated vec_id is several vectors; fewer vectors than k give as many centroids; ties go to the smaller
centroid number, between equal seeds to the smaller vector. Distances and sums must fit in a long; a larger one fails the
query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.llm.common import materialize, table


@dataclass(frozen=True)
class ClusterParams:
    """leading: rotated coordinates that are stored; dim, k, scale, rounds and seed: as the contract of the query has them."""

    dim: int = 64
    k: int = 40
    rounds: int = 5
    scale: int = 256
    seed: int = 2
    leading: int = 16


#: Components up to here keep all distances below 2^63 for 64 of them; larger ones are computed in Python's whole numbers.
SMALL = 1 << 27
MARGIN = 1e-9
ROWS_AT_ONCE = 1 << 13


def whole_vectors(embeddings: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, v): whole-number components floor(scale * x) of the vectors that take part."""
    good = (F.size("embedding") == dim) & F.forall("embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    held = lambda x: F.when(F.abs(x) < 2.0**62, F.floor(x)).otherwise(F.raise_error(F.lit("a component is too large")).cast("long"))
    v = F.transform("embedding", lambda c: held(c.cast("double") * scale))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def principal_axes(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes by falling variance as columns), from the moments of all vectors: each task sends one sum for each moment."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + dim + dim * dim)
        for batch in batches:
            x = _matrix(batch, "v", dim).astype(np.float64)
            total += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "total"])

    found = vectors.select("v").mapInArrow(moments, "i bigint, total double").groupBy("i").agg(F.sum("total").alias("total")).collect()
    total = np.zeros(1 + dim + dim * dim)
    for r in found:
        total[r.i] = r.total
    n = max(total[0], 1.0)
    mean = total[1 : 1 + dim] / n
    spread = total[1 + dim :].reshape(dim, dim) / n - np.outer(mean, mean)
    return mean, np.linalg.eigh((spread + spread.T) / 2)[1][:, ::-1]


def rotated(x: np.ndarray, mean: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading rotated coordinates, and the norm of the rest."""
    y = (x.astype(np.float64) - mean) @ axes
    return y[:, :leading], np.sqrt((y[:, leading:] ** 2).sum(axis=1))


def with_rotation(vectors: DataFrame, mean: np.ndarray, axes: np.ndarray, leading: int) -> DataFrame:
    """(vec_id, v, lead, rest)."""
    dim = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = rotated(_matrix(batch, "v", dim), mean, axes, leading)
            lists = pa.ListArray.from_arrays(np.arange(len(lead) + 1, dtype=np.int32) * leading, pa.array(lead.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), lists, pa.array(rest)], names=["vec_id", "v", "lead", "rest"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id bigint, v array<bigint>, lead array<double>, rest double")


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, c_lead: np.ndarray, c_rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance, how many distances were computed) for each row of x; the smaller number among equals."""
    largest = max((abs(int(f(a))) for a in (x, centroids) if a.size for f in (np.min, np.max)), default=0)
    if largest >= SMALL:
        x, centroids = x.astype(object), centroids.astype(object)
    bound = ((lead**2).sum(axis=1) + rest**2)[:, None] + ((c_lead**2).sum(axis=1) + c_rest**2)[None, :]
    margin = MARGIN * bound + 1
    bound -= 2 * (lead @ c_lead.T + rest[:, None] * c_rest[None, :])
    rows = np.arange(len(x))
    first = bound.argmin(axis=1)
    known = ((x - centroids[first]) ** 2).sum(axis=1)
    survives = bound - margin <= known.astype(np.float64)[:, None] * (1 + MARGIN)
    survives[rows, first] = False
    i, j = np.nonzero(survives)
    apart = ((x[i] - centroids[j]) ** 2).sum(axis=1)
    # The first of each row by (distance, number), with what was known before among the others.
    i, j, apart = np.concatenate([rows, i]), np.concatenate([first, j]), np.concatenate([known, apart])
    order = np.lexsort((j, apart, i)) if largest < SMALL else np.array(sorted(range(len(i)), key=lambda n: (i[n], apart[n], j[n])), dtype=np.int64)
    least = order[np.searchsorted(i[order], rows)]
    return j[least], apart[least], len(i)


def _assign(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, turned: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    dim, leading = centroids.shape[1], turned[0].shape[1]
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(at, ROWS_AT_ONCE)
            x, lead = _matrix(batch, "v", dim), _matrix(batch, "lead", leading)
            yield batch, x, *nearest(x, lead, batch.column("rest").to_numpy(), centroids, *turned)[:2]


def moved(stored: DataFrame, centroids: np.ndarray, turned: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Centroids after one round: the exact floor of the mean of each one's vectors; those without vectors stay."""
    k, dim = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dim), dtype=object), np.zeros(k, dtype=np.int64)
        for _, x, cluster, _ in _assign(batches, centroids, turned):
            order = np.argsort(cluster, kind="stable")
            found, starts = np.unique(cluster[order], return_index=True)
            ordered = x[order] if np.abs(x).max(initial=0) < SMALL else x[order].astype(object)
            total[found] += np.add.reduceat(ordered, starts, axis=0).astype(object)
            count += np.bincount(cluster.astype(np.int64), minlength=k)
        held = np.flatnonzero(count)
        values = pa.array([int(s) for s in total[held].ravel()], type=pa.int64())
        lists = pa.ListArray.from_arrays(np.arange(len(held) + 1, dtype=np.int32) * dim, values)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), lists, pa.array(count[held])], names=["cluster", "total", "n"])

    each = stored.mapInArrow(sums, "cluster int, total array<bigint>, n bigint")
    component = each.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s"))
    out = centroids.copy()
    for r in component.collect():
        out[r.cluster, r.i] = int(r.s) // r.n
    return out


def seeds(vectors: DataFrame, params: ClusterParams) -> np.ndarray:
    """The k vectors of least sha256 of `seed:vec_id`, by that order."""
    key = F.sha2(F.concat(F.lit(f"{params.seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(params.k).collect()
    return np.array([r.v for r in first], dtype=np.int64).reshape(len(first), params.dim)


def cluster(vectors: DataFrame, params: ClusterParams = ClusterParams()) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), final centroids) of (vec_id, v); the rows are a stored table."""
    spark = vectors.sparkSession
    vectors = materialize(vectors, "whole-vectors")
    centroids = seeds(vectors, params)
    schema = "vec_id bigint, cluster int, distance bigint"
    if not len(centroids):
        return spark.createDataFrame([], schema), centroids
    mean, axes = principal_axes(vectors, params.dim)
    stored = materialize(with_rotation(vectors, mean, axes, params.leading), "rotated-vectors")
    turn = lambda c: rotated(c, mean, axes, params.leading)
    for _ in range(params.rounds):
        centroids = moved(stored, centroids, turn(centroids))
    turned = turn(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, cluster_, distance in _assign(batches, centroids, turned):
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster_.astype(np.int32)), pa.array([int(d) for d in distance], type=pa.int64())], names=["vec_id", "cluster", "distance"])

    return materialize(stored.mapInArrow(run, schema), "assigned"), centroids


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector."""
    params = ClusterParams()
    assigned, centroids = cluster(whole_vectors(table(spark, sf_dir, "embeddings"), params.dim, params.scale), params)
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # One row for each centroid: as many as the parameter k at most.
    each = spark.createDataFrame([(c, s, sum(sums.values()), digest[c]) for c, s in sorted(sums.items())], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


_ASSIGN = """n{i} AS MATERIALIZED (
  SELECT id, vec_id, v, min(struct_pack(d := d, c := c)) AS best FROM (
    SELECT g.id, g.vec_id, g.v, c.c, list_sum(list_transform(list_zip(g.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM g, c{i} AS c)
  GROUP BY id, vec_id, v)"""
_MOVE = """s{j} AS MATERIALIZED (
  SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT best.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM n{i}) GROUP BY c, i),
m{j} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{j} GROUP BY c),
c{j} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} AS c LEFT JOIN m{j} AS m ON c.c = m.c)"""
OP11_SQL = (
    """
WITH g AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY key, v) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS key, v FROM g ORDER BY key, v LIMIT 40)),
"""
    + ",\n".join(f"{_ASSIGN.format(i=i)},\n{_MOVE.format(i=i, j=i + 1)}" for i in range(5))
    + ",\n"
    + _ASSIGN.format(i=5)
    + """
SELECT n.vec_id, CAST(n.best.c AS INTEGER) AS cluster, CAST(n.best.d AS BIGINT) AS distance,
  CAST(sum(n.best.d) OVER (PARTITION BY n.best.c) AS BIGINT) AS cluster_inertia, CAST(sum(n.best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM n5 AS n JOIN c5 AS c ON n.best.c = c.c
"""
)
