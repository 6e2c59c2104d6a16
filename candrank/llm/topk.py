"""Exact top-k inner products by no-random-access aggregation.

Each component of the vectors is a sorted list. Queries meet all vectors in blocks of bounded size (a grid of query
blocks and vector blocks, dealt by an equi-join key). In a block an eighth of the vectors is scored in full, which gives
each query a k-th score that the best must reach. For the others the lists are read in order to growing depth, from the
top for positive and from the bottom for negative query components; what was read and the last value read bound their
scores from above. Vectors whose bound is below the k-th score are never scored; reading ends for a query when only few
are left, whose scores are resolved one by one. Blocks are merged by Spark.

Defined results: vectors that are null, empty or hold null or non-finite components, and rows without vec_id, take no
part; only vectors of one length are compared; rows with the query's vec_id are its own; ties go to the smaller vec_id.
Components and scores must fit in a long; a larger score fails the query.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candrank.llm.common import materialize, table

SCALE = 64
#: Shares of the lists that are read before bounds are compared again; vectors left for a query at which reading ends.
DEPTHS = (0.5, 0.625, 0.75, 0.875)
FEW = 0.02
SEEDS = 8
QUERIES_AT_ONCE = 256
PAIRS_AT_ONCE = 1 << 18


def grid(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, v): whole-number components floor(scale * x)."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return embeddings.where(F.col("vec_id").isNotNull() & good).select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), x.alias("v"))


def bounds_at(x: np.ndarray, ordered: np.ndarray, rank: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """What components are at most (lists read down to depth from the top) and at least (from the bottom)."""
    n = len(x)
    return np.where(rank >= n - depth, x, ordered[n - depth - 1]), np.where(rank < depth, x, ordered[depth])


def kind_for(most: int) -> type:
    """Numbers in which sums of whole numbers up to most stay exact."""
    return np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64 if most < 2**62 else object


def best(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query_id, vec_id, score) of each query's k best among x, which may hold the query itself; and how many pairs were scored."""
    kind = kind_for(int(np.abs(queries).max(initial=0)) * int(np.abs(x).max(initial=0)) * x.shape[1])
    x, queries = x.astype(kind), queries.astype(kind)
    n = len(x)
    seeds = min(n, max(n // SEEDS, 2 * k))
    first, rest, rest_ids = x[:seeds], x[seeds:], ids[seeds:]
    rank = np.empty(rest.shape, dtype=np.int32)
    order = np.argsort(rest, axis=0, kind="stable")
    np.put_along_axis(rank, order, np.arange(len(rest), dtype=np.int32)[:, None], axis=0)
    ordered = np.take_along_axis(rest, order, axis=0)
    depths = sorted({d for share in DEPTHS if 0 < (d := int(len(rest) * share)) < len(rest)})
    bounds = [bounds_at(rest, ordered, rank, d) for d in depths]
    out, scored = [], 0
    for a in range(0, len(queries), QUERIES_AT_ONCE):
        q, qid = queries[a : a + QUERIES_AT_ONCE], query_ids[a : a + QUERIES_AT_ONCE]
        own = qid[:, None] == ids[None, :seeds]
        known = q @ first.T
        least = np.iinfo(np.int64).min if kind is np.int64 else -float("inf")
        reached = np.where(own, least, known)
        kth = np.partition(reached, seeds - k, axis=1)[:, seeds - k, None] if seeds >= k else np.full((len(q), 1), least)
        alive = qid[:, None] != rest_ids[None, :]
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        reading = np.arange(len(q))
        for up, down in bounds:
            alive[reading] &= plus[reading] @ up.T + minus[reading] @ down.T >= kth[reading]
            reading = reading[alive[reading].mean(axis=1) > FEW]
            if not len(reading):
                break
        i, j = np.nonzero(alive)
        score = np.empty(len(i), dtype=kind)
        for b in range(0, len(i), PAIRS_AT_ONCE):
            at = slice(b, b + PAIRS_AT_ONCE)
            score[at] = (q[i[at]] * rest[j[at]]).sum(axis=1)
        scored += known.size + len(i)
        i0, j0 = np.nonzero(~own & (known >= kth))
        i, j, score = np.concatenate([i0, i]), np.concatenate([ids[j0], rest_ids[j]]), np.concatenate([known[i0, j0], score])
        order = np.lexsort((j, -score, i)) if kind is not object else np.array(sorted(range(len(i)), key=lambda r: (i[r], -score[r], j[r])), dtype=np.int64)
        i, j, score = i[order], j[order], score[order]
        starts = np.searchsorted(i, np.arange(len(q)))
        kept = np.arange(len(i)) - starts[i] < k
        out.append((qid[i[kept]], j[kept], score[kept].astype(np.int64)))
    return *(np.concatenate([o[c] for o in out]) if out else np.zeros(0, dtype=np.int64) for c in range(3)), scored


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 20, query_block: int = 4096, vector_block: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score); both inputs are (vec_id, dim, v)."""
    blocks = {name: max(1, ceil(df.count() / size)) for name, df, size in (("q", queries, query_block), ("v", vectors, vector_block))}
    own = lambda name: F.pmod(F.xxhash64("vec_id"), F.lit(blocks[name])).cast("int").alias(name)
    each = lambda name: F.explode(F.sequence(F.lit(0), F.lit(blocks[name] - 1))).alias(name)
    left = queries.select("vec_id", "dim", F.col("v").alias("x"), own("q"), each("v"))
    right = vectors.select("vec_id", "dim", F.col("v").alias("x"), own("v"), each("q"))

    def solve(a: pa.Table, b: pa.Table) -> pa.Table:
        matrix = lambda t: t.column("x").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        found = best(matrix(a), a.column("vec_id").to_numpy(), matrix(b), b.column("vec_id").to_numpy(), k)[:3] if a.num_rows and b.num_rows else ([], [], [])
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), found)})

    partial = left.groupBy("dim", "q", "v").cogroup(right.groupBy("dim", "q", "v")).applyInArrow(solve, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every vec_id divisible by 20 against all rows; query_id, rank, vec_id, score."""
    vectors = materialize(grid(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors.where("vec_id % 20 = 0"), vectors)


OP4_SQL = """
WITH g AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM g q JOIN g c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
