"""Removal of byte strings that occur earlier in the corpus, by bounded interval expansion.

Every window of `length` bytes is owned by one anchor: its k-byte string of least hash. Equal windows have equal anchors
at equal places, so only occurrences of one anchor have to be compared. Anchors (some 3 in 100 byte positions) are
shuffled as hashes; those that occur once are done. Occurrences whose whole owned context is equal (by hash) are
duplicates of the first. What differs within an anchor is solved on bytes: the contexts, sorted from the anchor on, are
an interval of suffixes; backward extension byte by byte, breadth first, splits intervals by the preceding byte as a
Burrows-Wheeler transform does, and carries the common prefixes along; windows whose common prefix reaches the least
length are equal, and the extension stops when a window would no longer hold the anchor.

Rows are told apart by doc_id and 32 bits of a hash of their text, which are data, so a scan may deal rows as it likes.
Text that has to meet what was found is shuffled compressed. Equal anchors and contexts are told by 64-bit hashes each,
without a second look at the bytes: among 10 billion contexts the chance that any two of one anchor are mixed up is below
one in 10 billion.

Defined results: null text is empty; documents are ordered by doc_id, null first; different texts of one doc_id are
different documents, in order of their hashes (two of them are mixed up once in 4 billion pairs); rows equal in doc_id and
text are one document, and get equal rows; strings never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.llm.common import id_and_text, materialize, table

LENGTH = 100
ANCHOR = 36
CHUNK = 1 << 21
#: Contexts of one anchor that one task solves; anchors with more go another, equally exact way.
MOST = 20_000
LEAST = -(1 << 63)
PLACE = np.uint64((1 << 24) - 1)
MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, tuple] = {}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte value; powers of the base and of its inverse."""
    if not _powers:
        value = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64)
        base = 0x9E3779B97F4A7C15
        n = CHUNK + LENGTH + 2
        raised = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, np.uint64(b))])) for b in (base, pow(base, -1, 2**64))]
        _powers[0] = (value, *raised)
    return _powers[0]


def anchors(x: np.ndarray, begin: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, anchor place, anchor hash, context hash) over the documents that begin at begin in x."""
    value, up, down = _tables()
    n, width = len(x), length - k + 1
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(3)) + tuple(np.zeros(0, dtype=np.uint64) for _ in range(2))
    if n < length:
        return none
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(value[x] * down[:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * up[: n - k + 1]
    h ^= h >> np.uint64(32)
    h *= MIX
    h ^= h >> np.uint64(29)
    least = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    place = (least & PLACE).astype(np.int64)
    document = np.zeros(n + 1, dtype=np.int32)
    np.add.at(document, begin[begin < n], 1)
    document = np.cumsum(document[:n])
    inside = document[: n - length + 1] == document[length - 1 :]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(place)))
    held = inside[first]
    first, count = first[held], count[held]
    at = place[first]
    context = (sums[first + count + length - 1] - sums[first]) * up[first]
    context = (context + (at - first).astype(np.uint64) * MIX) * np.uint64(0x9FB21C651E98DF25) + count.astype(np.uint64)
    return first, count, at, h[at], context ^ (context >> np.uint64(31))


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Groups of (row in the batch, first byte, bytes) of about CHUNK bytes; longer texts overlap so that each window is in one piece."""
    rows, offsets, parts, held = [], [], [], 0
    for i, t in enumerate(texts):
        step = CHUNK - length
        for a in range(0, max(1, len(t) - length + 1), step):
            part = t[a : a + step + length - 1] if len(t) > CHUNK - length else t
            if held + len(part) > CHUNK and parts:
                yield rows, offsets, parts
                rows, offsets, parts, held = [], [], [], 0
            rows.append(i), offsets.append(a), parts.append(part)  # noqa: B018
            held += len(part)
            if part is t:
                break
    if parts:
        yield rows, offsets, parts


def occurrences(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """(key, context, doc, row, place): anchors of docs (doc, row, text); place packs the first window's start, the number of windows and the anchor's offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            for rows, offsets, parts in _pieces(texts, length):
                x = np.frombuffer(b"".join(parts), dtype=np.uint8)
                begin = np.cumsum([0, *map(len, parts)])[:-1]
                first, count, at, key, context = anchors(x, begin, length, k)
                part = np.searchsorted(begin, first, side="right") - 1
                index = pa.array(np.array(rows, dtype=np.int64)[part])
                start = first - begin[part] + np.array(offsets, dtype=np.int64)[part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(context.view(np.int64)), batch.column("doc").take(index), batch.column("row").take(index), pa.array((start << 16) | (count << 8) | (at - first))],
                    names=["key", "context", "doc", "row", "place"],
                )

    return docs.select("doc", "row", "text").mapInArrow(run, "key bigint, context bigint, doc bigint, row bigint, place bigint")


def expand(key: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray, left: list[bytes], right: list[bytes], length: int, k: int) -> np.ndarray:
    """Which windows (contexts x bytes before the anchor) occur earlier among the contexts of one anchor."""
    m, reach = len(key), length - k
    gone = np.zeros((m, reach + 1), dtype=bool)
    l_len, r_len = np.array([len(b) for b in left]), np.array([len(b) for b in right])
    before = np.frombuffer(b"".join(b[::-1].ljust(reach, b"\0") for b in left), dtype=np.uint8).reshape(m, reach)
    after = np.frombuffer(b"".join(b.ljust(length, b"\0") for b in right), dtype=np.uint8).reshape(m, length)
    rank = np.empty(m, dtype=np.int64)
    turn = np.lexsort((at, row, doc))
    other = [(x[turn][1:] != x[turn][:-1]) for x in (doc, row, at)]
    rank[turn] = np.concatenate([[0], np.cumsum(np.any(other, axis=0))])
    order = np.lexsort((r_len, np.ascontiguousarray(after).view(f"S{length}").ravel(), key))
    differ = after[order[1:]] != after[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    common = np.minimum(common, np.minimum(r_len[order[1:]], r_len[order[:-1]]))
    same = key[order[1:]] == key[order[:-1]]
    common = np.concatenate([[0], np.where(same, common, 0)])
    interval = np.concatenate([[0], np.cumsum(~same)])
    for r in range(reach + 1):
        need = length - r
        starts = np.flatnonzero(common < need)
        sizes = np.diff(np.append(starts, len(order)))
        least = np.minimum.reduceat(rank[order], starts) if len(starts) else rank[:0]
        later = rank[order] > np.repeat(least, sizes)
        gone[order[later], r] = True
        if r == reach:
            break
        # One byte further back: a stable order by (interval, preceding byte) keeps suffixes sorted within each.
        place = np.flatnonzero(l_len[order] > r)
        group = interval[place] * 256 + before[order[place], r]
        place = place[np.argsort(group, kind="stable")]
        group = interval[place] * 256 + before[order[place], r]
        if len(place) < 2:
            break
        same = group[1:] == group[:-1]
        ends = np.stack([place[:-1] + 1, place[1:] + 1], axis=1)
        ends[~same] = 0
        low = np.minimum.reduceat(np.append(common, 0), ends.ravel())[::2]
        common = np.concatenate([[0], np.where(same, low, 0)])
        order, interval = order[place], np.concatenate([[0], np.cumsum(~same)])
        alone = np.bincount(interval)[interval] == 1
        order, interval, common = order[~alone], interval[~alone], common[~alone]
        if not len(order):
            break
    return gone


def _solve(rows: pa.Table, length: int, k: int) -> pa.RecordBatch:
    rows = rows.combine_chunks()
    get = lambda c: rows.column(c).to_numpy()
    key, doc, row, at = (get(c) for c in ("key", "doc", "row", "at"))
    gone = expand(key, doc, row, at, rows.column("left").to_pylist(), rows.column("right").to_pylist(), length, k)
    edge = np.diff(np.pad(gone.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    i, near = np.nonzero(edge == 1)
    _, far = np.nonzero(edge == -1)
    return pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array(row[i]), pa.array(at[i] - far + 1), pa.array(at[i] - near + length)], names=["doc", "row", "from", "to"])


def _expanded(length: int, k: int):
    """Contexts sorted by key to ranges, whole keys at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            other = np.flatnonzero(key != key[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if held and (cut or held[-1].column("key")[-1].as_py() != int(key[0])):
                yield _solve(pa.Table.from_batches([*held, batch.slice(0, cut)]), length, k)
                held, batch = [], batch.slice(cut)
            elif cut:
                yield _solve(pa.Table.from_batches([batch.slice(0, cut)]), length, k)
                batch = batch.slice(cut)
            held.append(batch)
        if held:
            yield _solve(pa.Table.from_batches(held), length, k)

    return run


def window_ranges(contexts: DataFrame, length: int) -> DataFrame:
    """The same ranges for contexts (doc, row, at, left, right) too many for one task: windows as digests, grouped by Spark."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, start, digest = [], [], []
            for i, (at, left, right) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("at", "left", "right")))):
                b = left + right
                for p in range(min(len(left), len(b) - length) + 1):
                    index.append(i), start.append(at - len(left) + p), digest.append(hashlib.blake2b(b[p : p + length], digest_size=16).digest())  # noqa: B018
            index = pa.array(index, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest, pa.binary()), batch.column("doc").take(index), batch.column("row").take(index), pa.array(start, pa.int64())], names=["digest", "doc", "row", "from"]
            )

    each = materialize(contexts.mapInArrow(windows, "digest binary, doc bigint, row bigint, `from` bigint").distinct(), "windows")
    first = each.groupBy("digest").agg(F.min(F.struct("doc", "row", "from")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = each.join(materialize(first.select("digest", "first"), "first-windows"), "digest").where(F.struct("doc", "row", "from") > F.col("first"))
    return later.select("doc", "row", "from", (F.col("from") + length).alias("to"))


def compressed(docs: DataFrame) -> DataFrame:
    """docs with bytes in place of text: the text as UTF-8, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield batch.set_column(batch.schema.get_field_index("text"), "bytes", pa.array([pack(t.encode()) for t in batch.column("text").to_pylist()], pa.binary()))

    return docs.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" if f.name != "text" else "bytes binary" for f in docs.schema.fields))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, most: int = MOST) -> DataFrame:
    """(doc, row, from, to): byte ranges of docs (doc, row, text) that are covered by strings that occur earlier; they may overlap."""
    found = occurrences(docs, length, k)
    # Written, so that both sides of the next join come straight from a shuffle, whose hot keys Spark can split.
    twice = materialize(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    found = materialize(found.join(twice, "key"), "occurrences")
    least = F.min(F.struct("doc", "row", "place")).alias("least")
    contexts = materialize(found.groupBy("key", "context").agg(least, F.count("*").alias("n")), "contexts")
    copied = contexts.where("n > 1").select("key", "context", "least")
    first, windows, offset = (lambda c: F.shiftright(c, 16)), (lambda c: F.shiftright(c, 8).bitwiseAND(255)), (lambda c: c.bitwiseAND(255))
    place = F.col("place")
    later = found.join(copied, ["key", "context"]).where(F.struct("doc", "row", "place") != F.col("least"))
    whole = later.select("doc", "row", first(place).alias("from"), (first(place) + windows(place) + length - 1).alias("to"))
    many = materialize(contexts.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "open-keys")
    place = F.col("least.place")
    open_ = contexts.join(many, "key").select("key", "c", "least.doc", "least.row", (first(place) + offset(place)).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows, keys, places, left, right = [], [], [], [], []
            for i, (packed, wanted_) in enumerate(zip(batch.column("bytes").to_pylist(), batch.column("wanted").to_pylist())):
                b = unpack(packed)
                for w in wanted_:
                    a = w["at"]
                    rows.append(i), keys.append(w["key"]), places.append(a)  # noqa: B018
                    left.append(b[max(0, a - (length - k)) : a]), right.append(b[a : a + length])  # noqa: B018
            index = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), batch.column("doc").take(index), batch.column("row").take(index), pa.array(places, pa.int64()), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                names=["key", "doc", "row", "at", "left", "right"],
            )

    def bytes_of(places: DataFrame) -> DataFrame:
        wanted = places.groupBy("doc", "row").agg(F.collect_list(F.struct("key", "at")).alias("wanted"))
        rows = compressed(docs).join(wanted, ["doc", "row"]).select("doc", "row", "bytes", "wanted")
        return rows.mapInArrow(cut, "key bigint, doc bigint, row bigint, at bigint, left binary, right binary")

    parts = bytes_of(open_.where(F.col("c") <= most)).repartition("key").sortWithinPartitions("key").mapInArrow(_expanded(length, k), "doc bigint, row bigint, `from` bigint, `to` bigint")
    out = whole.unionByName(parts)
    if not many.where(F.col("c") > most).isEmpty():
        out = out.unionByName(window_ranges(bytes_of(open_.where(F.col("c") > most)), length))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, most: int = MOST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept holds the remaining bytes."""
    rows = id_and_text(docs)
    rows = rows.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("doc"), F.xxhash64("text").bitwiseAND(0xFFFFFFFF).alias("row"), "text")
    ranges = repeated_ranges(rows.select("doc", "row", "text"), length, k, most).groupBy("doc", "row").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for packed, found in zip(batch.column("bytes").to_pylist(), batch.column("ranges").to_pylist()):
                b = unpack(packed)
                spans: list[list[int]] = []
                for a, z in sorted((r["from"], r["to"]) for r in found or ()):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], z)
                    else:
                        spans.append([a, z])
                edges = [0, *(e for s in spans for e in s), len(b)]
                rest = b"".join(b[a:z] for a, z in zip(edges[::2], edges[1::2]))
                n_bytes.append(len(b)), n_removed.append(len(b) - len(rest)), n_spans.append(len(spans)), kept.append(rest)  # noqa: B018
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    joined = compressed(rows).join(ranges, ["doc", "row"], "left").select("doc_id", "bytes", "ranges")
    return joined.mapInArrow(apply, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
