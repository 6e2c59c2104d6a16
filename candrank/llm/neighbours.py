"""Approximate nearest neighbours by balanced posting lists.

Equal vectors are one row that keeps its k + 1 smallest ids, which is all that any query can name of it. A bounded sample is
halved again and again at the median, so that all leaves hold as many vectors; the leaves' means are the centroids. A graph
links each centroid with near ones that no nearer neighbour stands for, and is searched best first from a few entries; it is
small and goes to all tasks. Every row is put into the list of its nearest centroid and, near a boundary, into a few more.

A query takes the lists whose centroids are at most some ratio farther than its nearest. The ratio is learned: for some
sample vectors the exact neighbours among all rows are found in one scan, and the ratio is the quantile of what those would
have needed. The beam widens until it ends beyond the ratio, so nothing caps the lists of a query. Lists meet their queries
in blocks of bounded size (an equi-join key for each pair of blocks), where distances are exact; Spark merges the blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without vec_id, take no
part; only vectors of one length are compared; a vec_id that repeats with the same vector counts once, with other vectors each;
rows with the query's vec_id are its own; ties go to the smaller vec_id; a query gets k neighbours, or all where there are fewer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candrank.llm.common import materialize, table


@dataclass(frozen=True)
class IndexParams:
    """list_size: vectors a list, as far as there are centroids; lists: most centroids; sample: vectors that centroids are fitted on;
    replicas, boundary: lists of a vector, and how much farther than the nearest; degree, beam: of the graph; calibration:
    sample vectors for the ratio; target: share of their neighbours within it; posting_block, query_block: rows of a task's group."""

    k: int = 10
    list_size: int = 128
    lists: int = 4096
    sample: int = 32_768
    replicas: int = 3
    boundary: float = 1.2
    degree: int = 24
    beam: int = 16
    calibration: int = 256
    target: float = 0.955
    posting_block: int = 8_192
    query_block: int = 512


@dataclass(frozen=True)
class Index:
    """centroids; links: near centroids of each, -1 where there are fewer; entries: where a search begins."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * (a @ b.T), 0.0)


def balanced_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Means of the leaves of a tree that halves x along the line between two means, at the median."""
    leaves = [np.arange(len(x))]
    for _ in range(max(0, ceil(log2(max(lists, 1))))):
        halves = []
        for rows in leaves:
            part = x[rows]
            far = part[((part - part[0]) ** 2).sum(axis=1).argmax()]
            means = np.stack([part[((part - far) ** 2).sum(axis=1).argmax()], far])
            for _ in range(4):
                side = squared(part, means).argmin(axis=1)
                means = np.stack([part[side == s].mean(axis=0) if (side == s).any() else means[s] for s in (0, 1)])
            order = np.argsort(part @ (means[1] - means[0]), kind="stable")
            halves += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
        leaves = halves
    return np.stack([x[rows].mean(axis=0) for rows in leaves if len(rows)])


def linked(centroids: np.ndarray, degree: int) -> Index:
    """The graph: of the nearest 2 x degree centroids, in order, those that are nearer than to any neighbour taken before."""
    n = len(centroids)
    near = min(2 * degree, n - 1)
    links = np.full((n, max(degree, 1)), -1, dtype=np.int32)
    for at in range(0, n, 256) if near else ():
        rows = np.arange(at, min(n, at + 256))
        d = squared(centroids[rows], centroids)
        d[np.arange(len(rows)), rows] = np.inf
        some = np.argpartition(d, near - 1, axis=1)[:, :near]
        order = np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, axis=1), axis=1, kind="stable"), axis=1)
        own = np.take_along_axis(d, order, axis=1)
        between = np.stack([squared(centroids[o], centroids[o]) for o in order])
        taken = np.zeros(order.shape, dtype=bool)
        for j in range(near):
            covered = (taken[:, :j] & (between[:, :j, j] < own[:, j, None])).any(axis=1)
            taken[:, j] = ~covered & (taken.sum(axis=1) < degree)
        for row, o, t in zip(rows, order, taken):
            links[row, : t.sum()] = o[t]
    entries = list(range(0, n, max(1, n // max(1, int(n**0.5)))))
    seen = np.zeros(n, dtype=bool)
    wave = np.array(entries)
    while True:  # every centroid can be reached from an entry
        while len(wave):
            seen[wave] = True
            wave = np.unique(links[wave])
            wave = wave[(wave >= 0) & ~seen[wave]]
        if seen.all():
            return Index(centroids, links, np.array(sorted(entries)))
        entries.append(int(seen.argmin()))
        wave = np.array(entries[-1:])


def search(index: Index, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, squared distances) of the nearest found for each row of q, nearest first: best-first search that ends when all of the beam was expanded."""
    n = len(index.centroids)
    if 4 * beam >= n:
        d = squared(q, index.centroids)
        order = np.argsort(d, axis=1, kind="stable")[:, :beam]
        return order, np.take_along_axis(d, order, axis=1)
    c2 = (index.centroids**2).sum(axis=1)
    ids, ds = np.zeros((len(q), beam), dtype=np.int64), np.zeros((len(q), beam))
    for at in range(0, len(q), 512):
        x = q[at : at + 512]
        rows, x2 = np.arange(len(x)), (x**2).sum(axis=1)
        seen = np.zeros((len(x), n), dtype=bool)
        seen[:, index.entries] = True
        found, far = np.broadcast_to(index.entries, (len(x), len(index.entries))), squared(x, index.centroids[index.entries])
        expanded = np.zeros(found.shape, dtype=bool)
        active = rows
        while True:
            order = np.argsort(far, axis=1, kind="stable")[:, :beam]
            found, far, expanded = (np.take_along_axis(a, order, axis=1) for a in (found, far, expanded))
            open_ = ~expanded & np.isfinite(far)
            active = np.flatnonzero(open_.any(axis=1))
            if not len(active):
                break
            first = open_[active].argmax(axis=1)
            expanded[active, first] = True
            links = index.links[found[active, first]].astype(np.int64)
            fresh = (links >= 0) & ~seen[active[:, None], links]
            seen[active[:, None], np.where(links >= 0, links, found[active, first][:, None])] = True
            d = np.full((len(x), links.shape[1]), np.inf)
            dots = np.einsum("bnd,bd->bn", index.centroids[links], x[active])
            d[active] = np.where(fresh, np.maximum(c2[links] - 2 * dots + x2[active, None], 0.0), np.inf)
            new = np.zeros((len(x), links.shape[1]), dtype=np.int64)
            new[active] = np.maximum(links, 0)
            found, far, expanded = np.concatenate([found, new], axis=1), np.concatenate([far, d], axis=1), np.concatenate([expanded, np.zeros(d.shape, dtype=bool)], axis=1)
        width = found.shape[1]
        ids[at : at + len(x), :width], ds[at : at + len(x), :width] = found, far
        ds[at : at + len(x), width:] = np.inf
    return ids, ds


def reference(d: np.ndarray) -> np.ndarray:
    """The distance that ratios are taken of: to the nearest centroid that the vector is not equal to."""
    return np.where(d > 0, d, np.inf).min(axis=1)


def within(index: Index, q: np.ndarray, ratio: float, beam: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(centroids, distances) at most ratio times as far as the nearest, nearest first; the beam widens until it ends beyond that."""
    out: list = [None] * len(q)
    rows = np.arange(len(q))
    while len(rows):
        ids, d = search(index, q[rows], beam)
        d = np.sqrt(d)
        limit = ratio * reference(d)
        done = (d[:, -1] > limit) | (4 * beam >= len(index.centroids)) & (ids.shape[1] == len(index.centroids))
        for i in np.flatnonzero(done):
            held = (d[i] <= limit[i]) | (np.arange(d.shape[1]) == 0)
            out[rows[i]] = ids[i][held], d[i][held]
        rows, beam = rows[~done], beam * 4 if 16 * beam < len(index.centroids) else len(index.centroids)
    return out


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, dim, a, b, v): a and b are hashes of v."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    good = F.col("vec_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda c: c != 0)
    v = F.transform(x, lambda c: c + F.lit(0.0).cast(embeddings.schema["embedding"].dataType.elementType))  # -0.0 is 0.0
    return embeddings.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.size(x).alias("dim"), v.alias("v")).select("vec_id", "dim", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"), "v")


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """(dim, a, b, v, ids): each different vector with its k + 1 smallest ids. The rank is limited before the shuffle too."""
    rank = F.dense_rank().over(Window.partitionBy("a", "b").orderBy("vec_id"))
    first = vectors.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    return first.groupBy("a", "b").agg(F.min("dim").alias("dim"), F.min_by("v", "vec_id").alias("v"), F.sort_array(F.collect_set("vec_id")).alias("ids"))


def _matrix(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    column = batch.column("v")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield int(dim), batch.filter(pa.array(dims == dim))


def _with_lists(batch: pa.RecordBatch, lists: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0, *(len(x) for x in lists)])
    column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists) if lists else [], pa.int32()))
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "lists"])


def fit(vectors: DataFrame, params: IndexParams) -> tuple[dict[int, Index], dict[int, np.ndarray]]:
    """(index, sample) of each length of vectors; centroids in number and size are bounded by the parameters."""
    indexes, samples = {}, {}
    for row in vectors.groupBy("dim").count().collect():
        of_dim = vectors.where(F.col("dim") == row["dim"]).select("v")
        few = of_dim.sample(fraction=min(1.0, 1.1 * params.sample / row["count"]), seed=13).limit(params.sample)
        x = np.unique(np.array([r.v for r in few.collect()], dtype=np.float64).reshape(-1, row["dim"]), axis=0)
        x = x[np.random.default_rng(7).permutation(len(x))]
        lists = min(params.lists, len(x) // 8, row["count"] // params.list_size)
        centroids = balanced_centroids(x, 2 ** int(log2(lists))) if lists > 1 else np.zeros((1, row["dim"]))
        indexes[row["dim"]], samples[row["dim"]] = linked(centroids, params.degree), x[: params.calibration]
    return indexes, samples


def routed(vectors: DataFrame, indexes: dict[int, Index], params: IndexParams) -> DataFrame:
    """vectors (dim, a, b, v, ids) with the lists of each."""
    known = vectors.sparkSession.sparkContext.broadcast(indexes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                ids, d = search(known.value[dim], _matrix(part), params.beam)
                d = np.sqrt(d[:, : params.replicas])
                near = d <= params.boundary * reference(d)[:, None]
                near[:, 0] = True
                yield _with_lists(part, [row[held] for row, held in zip(ids[:, : params.replicas], near)])

    return vectors.mapInArrow(run, f"{_ddl(vectors)}, lists array<int>")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def needed_ratio(postings: DataFrame, indexes: dict[int, Index], samples: dict[int, np.ndarray], params: IndexParams) -> float:
    """The ratio within which the target share of the sample vectors' exact neighbours would be found."""
    spark, k = postings.sparkSession, params.k
    known = spark.sparkContext.broadcast((indexes, samples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dim, part in _by_dim(batch):
                index, q = known.value[0][dim], known.value[1][dim]
                d = squared(q, _matrix(part))
                d[d <= 1e-12 * (q**2).sum(axis=1)[:, None]] = np.inf  # the vector itself is always found
                few = np.argsort(d, axis=1)[:, :k]
                lists = part.column("lists")
                starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
                away = np.sqrt(squared(q, index.centroids))
                away /= np.where(away > 0, away, np.inf).min(axis=1)[:, None]
                ratio = np.array([[min(away[i, c] for c in flat[starts[j] : starts[j + 1]]) for j in row] for i, row in enumerate(few)]).reshape(len(q), -1)
                old = best.get(dim, (np.zeros((len(q), 0)), np.zeros((len(q), 0))))
                d, ratio = np.concatenate([old[0], np.take_along_axis(d, few, axis=1)], axis=1), np.concatenate([old[1], ratio], axis=1)
                keep = np.argsort(d, axis=1, kind="stable")[:, :k]
                best[dim] = np.take_along_axis(d, keep, axis=1), np.take_along_axis(ratio, keep, axis=1)
        for dim, (d, ratio) in best.items():
            i, j = np.nonzero(np.isfinite(d))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim)), pa.array(i), pa.array(d[i, j]), pa.array(ratio[i, j])], names=["dim", "q", "d", "ratio"])

    rank = F.row_number().over(Window.partitionBy("dim", "q").orderBy("d", "ratio"))
    found = postings.select("dim", "v", "lists").mapInArrow(run, "dim bigint, q bigint, d double, ratio double").withColumn("rank", rank).where(F.col("rank") <= k).select("ratio").collect()
    return float(np.quantile([r.ratio for r in found], params.target)) if found else 1.0


def probes(queries: DataFrame, indexes: dict[int, Index], sizes: dict[tuple[int, int], int], ratio: float, params: IndexParams) -> DataFrame:
    """queries (dim, a, b, v) with the lists of each: those within the ratio, and as many more as k neighbours take for certain."""
    known = queries.sparkSession.sparkContext.broadcast((indexes, {dim: np.array([sizes.get((dim, i), 0) for i in range(len(x.centroids))]) for dim, x in indexes.items()}))
    enough = params.replicas * (params.k + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                index, held = known.value[0][dim], known.value[1][dim]
                q = _matrix(part)
                lists = [ids for ids, _ in within(index, q, ratio, params.beam)]
                for i, ids in enumerate(lists):
                    if held[ids].sum() < enough:
                        order = np.argsort(squared(q[i : i + 1], index.centroids)[0], kind="stable")
                        some = order[: np.searchsorted(np.cumsum(held[order]), enough) + 1]
                        lists[i] = np.union1d(ids, some)
                yield _with_lists(part, lists)

    return queries.mapInArrow(run, f"{_ddl(queries)}, lists array<int>")


def _sizes(df: DataFrame, weight: Column) -> dict[tuple[int, int], int]:
    """Of each list of each length; as many rows as there are centroids."""
    return {(r.dim, r.list): r.n for r in df.select("dim", weight.alias("w"), F.explode("lists").alias("list")).groupBy("dim", "list").agg(F.sum("w").alias("n")).collect()}


def nearest_in_block(q: np.ndarray, x: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, distance) of the k + 1 nearest by (distance, least id); distances are sums of squared differences."""
    d = squared(q, x)
    few = min(k + 1, len(x))
    edge = np.partition(d, few - 1, axis=1)[:, few - 1]
    slack = 1e-11 * ((q**2).sum(axis=1) + (x**2).sum(axis=1).max())
    i, j = np.nonzero(d <= (edge + slack)[:, None])
    exact = np.concatenate([np.sqrt(((q[i[at : at + 65_536]] - x[j[at : at + 65_536]]) ** 2).sum(axis=1)) for at in range(0, len(i), 65_536)])
    order = np.lexsort((least[j], exact, i))
    i, j, exact = i[order], j[order], exact[order]
    kept = np.arange(len(i)) - np.searchsorted(i, np.arange(len(q)))[i] < k + 1
    return i[kept], j[kept], exact[kept]


def search_lists(queries: DataFrame, postings: DataFrame, params: IndexParams) -> DataFrame:
    """(qa, qb, near): for each query vector its k + 1 nearest different vectors as (score, ids), from blocks of its lists."""
    held, asked = _sizes(postings, F.lit(1)), _sizes(queries, F.lit(1))
    blocks = [(dim, i, ceil(held[dim, i] / params.posting_block), ceil(n / params.query_block)) for (dim, i), n in asked.items() if (dim, i) in held]
    # As many rows as there are centroids at most.
    cut = F.broadcast(queries.sparkSession.createDataFrame(blocks, "dim int, list int, pn int, qn int"))
    own = lambda n, name: F.pmod(F.xxhash64("b", "a"), F.col(n)).cast("int").alias(name)
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    lists = lambda df, *more: df.select("dim", F.explode("lists").alias("list"), "a", "b", "v", *more).join(cut, ["dim", "list"])
    left = lists(queries).select("dim", "list", "a", "b", "v", own("qn", "q"), each("pn", "p"))
    right = lists(postings, "ids").select("dim", "list", "a", "b", "v", "ids", own("pn", "p"), each("qn", "q"))
    schema = pa.schema([*((c, pa.int64()) for c in ("qa", "qb", "a", "b")), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])

    def solve(q: pa.Table, x: pa.Table) -> pa.Table:
        if not q.num_rows or not x.num_rows:
            return schema.empty_table()
        ids = x.column("ids").combine_chunks()
        least = ids.values.to_numpy()[ids.offsets.to_numpy()[:-1]]
        i, j, score = nearest_in_block(_matrix(q), _matrix(x), least, params.k)
        return pa.table([q.column("a").take(i), q.column("b").take(i), x.column("a").take(j), x.column("b").take(j), pa.array(score), ids.take(pa.array(j))], schema=schema)

    found = left.groupBy("dim", "list", "p", "q").cogroup(right.groupBy("dim", "list", "p", "q")).applyInArrow(solve, "qa bigint, qb bigint, a bigint, b bigint, score double, ids array<bigint>")
    # A vector comes once from each of its lists; equal rows have one rank.
    rank = F.dense_rank().over(Window.partitionBy("qa", "qb").orderBy("score", F.col("ids")[0], "a", "b"))
    return found.withColumn("rank", rank).where(F.col("rank") <= params.k + 1).groupBy("qa", "qb").agg(F.collect_set(F.struct("score", "ids")).alias("near"))


def nearest(embeddings: DataFrame, every: int, params: IndexParams = IndexParams()) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each vector whose vec_id is divisible by every, among all others."""
    vectors = usable(embeddings)
    indexes, samples = fit(vectors, params)
    postings = materialize(routed(distinct_vectors(vectors, params.k), indexes, params), "postings")
    asking = vectors.where(F.col("vec_id") % every == 0)
    different = materialize(asking.groupBy("a", "b").agg(F.min("dim").alias("dim"), F.min_by("v", "vec_id").alias("v"), F.count("*").alias("n")), "query-vectors")
    ratio = needed_ratio(postings, indexes, samples, params)
    sizes = _sizes(postings, F.size("ids"))
    asked = materialize(probes(different.select("dim", "a", "b", "v"), indexes, sizes, ratio, params), "probes")
    near = search_lists(asked, postings, params)
    salts = max(1, ceil((different.agg(F.max("n")).first()[0] or 1) / 4096))
    near = near.select("qa", "qb", "near", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    ids = asking.select("vec_id", F.col("a").alias("qa"), F.col("b").alias("qb"), F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int").alias("salt")).distinct()
    pairs = F.flatten(F.transform("near", lambda x: F.transform(x["ids"], lambda i: F.struct(x["score"].alias("score"), i.alias("vec_id")))))
    first = F.slice(F.array_sort(F.array_distinct(F.filter(pairs, lambda x: x["vec_id"] != F.col("query_id")))), 1, params.k)
    joined = ids.join(near, ["qa", "qb", "salt"]).select(F.col("vec_id").alias("query_id"), "near")
    out = joined.select("query_id", F.posexplode(first).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every vec_id divisible by 100 against all rows; query_id, rank, vec_id, score."""
    return nearest(table(spark, sf_dir, "embeddings"), 100)
