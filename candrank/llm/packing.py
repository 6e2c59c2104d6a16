"""Best-fit packing of tokenised documents by patterns: non-negative least squares on the histogram of lengths.

Pieces of documents become rows without their ids. Of them only the histogram of lengths, which has as many bins as a
sequence has tokens, goes to the driver. There all patterns of two or three lengths that fill a sequence get repeat
counts by non-negative least squares; counts are rounded to whole numbers that the histogram holds, and best fit over
what is left packs the rest. The plan (a table of bounded size) goes back, and each piece takes the place of its rank
among the pieces of its length.

Defined results: null text is empty and becomes one piece that holds the closing id alone; an empty table gives no row;
rows that repeat a doc_id are packed each.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candrank.llm.bpe import VOCABULARY, coder
from candrank.llm.common import id_and_text, materialize, small_batches, table

END_ID = 2
ROWS_A_BUCKET = 1_000_000


def pieces(docs: DataFrame, size: int = 1024, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): longer documents are cut so that the first piece takes the remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(batch.column("text")):  # one at a time
                ids = np.append(c.array(text.as_py()), np.uint32(END_ID)).astype("<u4", copy=False)
                cuts = [0, *range((len(ids) - 1) % size + 1, len(ids) + 1, size)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(k), piece.append(i), start.append(a), length.append(b - a), crc.append(zlib.crc32(ids[a:b]))  # noqa: B018
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return id_and_text(docs).mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def full_patterns(size: int) -> np.ndarray:
    """All a >= b >= c >= 0 of two or three lengths that fill a sequence; 0 means no third length."""
    a, b = np.meshgrid(np.arange(1, size), np.arange(1, size), indexing="ij")
    c = size - a - b
    held = (a >= b) & (b >= c) & (c >= 0)
    return np.stack([a[held], b[held], c[held]], axis=1)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 1000, change: float = 1e-4) -> np.ndarray:
    """Non-negative least squares: repeats whose lengths come nearest to the histogram, by multiplicative steps until they stand still."""
    p = patterns
    b = histogram.astype(float).copy()
    b[0] = 0.0
    use = (b[p[:, 0]] > 0) & (b[p[:, 1]] > 0) & ((p[:, 2] == 0) | (b[p[:, 2]] > 0))
    x = np.where(use, 1.0, 0.0)
    weight = lambda v: v[p[:, 0]] + v[p[:, 1]] + np.where(p[:, 2] > 0, v[p[:, 2]], 0.0)
    wanted = weight(b)
    for _ in range(rounds):
        made = sum(np.bincount(p[:, i], weights=x, minlength=len(b)) for i in range(3))
        made[0] = 0.0
        before, x = x, x * (wanted / np.maximum(weight(made), 1e-12))
        if np.abs(x - before).sum() <= change * x.sum():
            break
    return x


def _taken(patterns: np.ndarray, whole: np.ndarray, histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeats, never more than the histogram still holds. Changes histogram."""
    out = []
    for k in np.flatnonzero(whole):
        pattern = tuple(int(v) for v in patterns[k] if v)
        need = {v: pattern.count(v) for v in pattern}
        n = min([int(whole[k]), *(int(histogram[v]) // m for v, m in need.items())])
        if n > 0:
            for v, m in need.items():
                histogram[v] -= n * m
            out.append((pattern, n))
    return out


def round_repeats(patterns: np.ndarray, x: np.ndarray, histogram: np.ndarray, share: float = 0.9) -> list[tuple[tuple[int, ...], int]]:
    """Repeats rounded down, then their fractions carried along, but for the tenth that best fit needs to fill its gaps. Changes histogram."""
    whole = np.floor(x + 1e-9)
    out = _taken(patterns, whole.astype(np.int64), histogram)
    carried = np.floor(np.concatenate([[0.0], np.cumsum((x - whole) * share)]) + 0.5)
    return out + _taken(patterns, np.diff(carried).astype(np.int64), histogram)


def best_fit(histogram: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over counts instead of pieces."""
    room: dict[int, dict[tuple[int, ...], int]] = {}
    spaces: list[int] = []

    def put(pattern: tuple[int, ...], n: int) -> None:
        left = size - sum(pattern)
        if left not in room:
            room[left] = {}
            spaces.insert(bisect_left(spaces, left), left)
        room[left][pattern] = room[left].get(pattern, 0) + n

    for length in range(size, 0, -1):
        n = int(histogram[length])
        while n:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                each = size // length
                if n >= each:
                    put((length,) * each, n // each)
                if n % each:
                    put((length,) * (n % each), 1)
                break
            space = spaces[at]
            pattern, m = room[space].popitem()
            if not room[space]:
                del room[space], spaces[at]
            used = min(n, m)
            if m > used:
                put(pattern, m - used)
            put((*pattern, length), used)
            n -= used
    return [x for group in room.values() for x in group.items()]


def plan(histogram: dict[int, int], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For ranks within each length: (length, first rank, first sequence, offset), sorted by length and rank."""
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    patterns = full_patterns(size)
    bins = round_repeats(patterns, fit_repeats(patterns, left), left) if len(patterns) else []
    bins += best_fit(left, size)
    ranks, sequence, rows = dict.fromkeys(histogram, 0), 0, []
    for pattern, n in bins:
        offset = 0
        for length in pattern:
            rows.append((length, ranks[length], sequence, offset))
            ranks[length] += n
            offset += length
        sequence += n
    rows.sort()
    return tuple(np.array([r[i] for r in rows], dtype=np.int64) for i in range(4))


def pack(docs: DataFrame, size: int = 1024, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each piece with its sequence and its place there."""
    with small_batches(docs.sparkSession):
        cut = materialize(pieces(docs, size, vocabulary).withColumn("number", F.monotonically_increasing_id()), "pieces")
    histogram = dict(cut.groupBy("length").count().collect())
    lengths, ranks, sequences, offsets = plan(histogram, size)
    buckets = max(64, sum(histogram.values()) // ROWS_A_BUCKET)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("number"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "number")
    ranked = cut.withColumn("rank", F.row_number().over(own) - 1).join(sums, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    keys = (lengths << 44) + ranks

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            where = pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *where], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    kept = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("bigint"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(table(spark, sf_dir, "documents"))
