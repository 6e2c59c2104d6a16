"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints are reduced to distinct values first, so exact copies and equal fingerprints cost one row each. They meet in
buckets. In a bucket the sorted fingerprints are an implicit binary trie: node pairs go down together, add up differing
bits, and stop beyond the error budget or where both subtrees are already in one component. Buckets give out spanning
links, not pairs; components of all links follow by Spark joins (large star and small star). A bucket of very many
fingerprints is cut into blocks, each pair of which is a bucket of its own, so that no task grows with the largest bucket.

near_duplicates: links are fingerprints of 64 bits at most a few bits apart. Two of them agree in at least two of
distance + 2 blocks of bits, so each goes to one bucket for each pair of blocks; no link is lost.

similar_documents: links stand for a Jaccard similarity of the sets of shingles. That needs longer fingerprints (256 bits)
and a budget of some 48 bits, where blocks of bits tell nothing apart; buckets are bands of MinHash values instead. Two
documents of similarity 0.8 share one of the bands in 99 of 100 cases, and 95 of 100 are within the budget.

Defined results: null or empty text, or text without a word, has fingerprint 0 and is linked to its like; rows that repeat
a doc_id stay rows; a null doc_id is never a component id unless a whole component has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.llm.common import id_and_text, map_texts, materialize, table

SEED = 42
#: Fingerprints of one bucket that one task takes; of a larger bucket, two blocks of this size at a time.
BLOCK = 20_000
#: Node pairs that are held at once.
FRONTIER = 1 << 20
#: Longer fingerprints: words of 64 bits; bands of MinHash values, and values a band.
WORDS, BANDS, BAND = 4, 12, 5
KEY = ("pair", "bits", "low", "high")
_numbers = np.random.default_rng(9).integers(1, 2**63, BANDS * BAND + WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of each run of words (of all words, if fewer). bytes.lower() changes A-Z alone, bytes.split() cuts at the six ASCII blanks."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    stops = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(joined)]
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), dtype="<u8", count=len(stops))


def majority(hashes: np.ndarray) -> np.ndarray:
    """Words of 64 bits: a bit is set if set in over half of the rows of hashes (n x words)."""
    ones = np.zeros(64 * hashes.shape[1], dtype=np.int64)
    for at in range(0, len(hashes), 255):  # so many bits add up in a byte
        block = np.ascontiguousarray(hashes[at : at + 255]).view(np.uint8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def simhash(text: str, shingle: int) -> int:
    """64-bit fingerprint of all shingles, repeats included; 0 without a word."""
    return int(majority(shingle_hashes(text, shingle)[:, None])[0])


def sketch(text: str, shingle: int) -> tuple[bytes, np.ndarray]:
    """Fingerprint of WORDS x 64 bits of the set of shingles, and a key for each band of MinHash values."""
    h = np.unique(shingle_hashes(text, shingle))
    wide = h[:, None] * _numbers[-WORDS:]
    wide ^= wide >> np.uint64(32)
    wide *= np.uint64(0xD6E8FEB86659FD93)
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), 4096):
        np.minimum(least, (h[at : at + 4096, None] * _numbers[:-WORDS]).min(axis=0), out=least)
    keys = np.zeros(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return majority(wide ^ (wide >> np.uint64(29))).astype(">u8").tobytes(), keys.view(np.int64)


def budget(similarity: float, bits: int = 64 * WORDS) -> int:
    """Differing bits that 95 of 100 pairs of this Jaccard similarity stay within: the angle between their sets, and its spread."""
    p = acos(2 * similarity / (1 + similarity)) / pi
    return int(bits * p + 1.645 * sqrt(bits * p * (1 - p)))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""
    return map_texts(id_and_text(docs), lambda texts: {"fp": np.array([simhash(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)}, "fp bigint")


def _buckets(fp: Column, distance: int) -> Column:
    """One struct (pair of blocks, their bits) for each pair of the distance + 2 blocks of bits."""
    cuts = [64 * i // (distance + 2) for i in range(distance + 3)]
    block = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
    pairs = list(combinations(range(distance + 2), 2))
    return F.array(*[F.struct(F.lit(n).alias("pair"), F.shiftleft(block[i], cuts[j + 1] - cuts[j]).bitwiseOR(block[j]).alias("bits")) for n, (i, j) in enumerate(pairs)])


def _components(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Least index reachable, from the labels so far and more links."""
    while len(a):
        x, y = label[a], label[b]
        ne = x != y
        if not ne.any():
            break
        a, b, x, y = a[ne], b[ne], x[ne], y[ne]
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _orders(fps: np.ndarray, bucket: np.ndarray) -> Iterator[np.ndarray]:
    """Orders within buckets that begin at other bits."""
    words = fps.shape[1]
    for word in range(words):
        for turn in range(0, 64, 8 * words):
            x = fps[:, word]
            turned = (x << np.uint64(turn)) | (x >> np.uint64(64 - turn)) if turn else x
            yield np.lexsort((*(fps[:, (word + i) % words] for i in range(words - 1, 0, -1)), turned, bucket))


def trie_links(fps: np.ndarray, starts: np.ndarray, distance: int) -> np.ndarray:
    """Component label (an index) of each of fps (n x words of 64 bits), sorted within buckets that begin at starts."""
    fps = fps.reshape(len(fps), -1)
    n, ends, bits = len(fps), np.append(starts[1:], len(fps)), 64 * fps.shape[1]
    label = np.arange(n)
    bucket = np.zeros(n, dtype=np.int64)
    bucket[starts] = 1
    bucket = np.cumsum(bucket)
    apart = lambda a, b: np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1, dtype=np.int64)
    # Neighbours first: dense groups join here, cheaply.
    for order in _orders(fps, bucket):
        a, b = order[:-1], order[1:]
        near = (bucket[a] == bucket[b]) & (apart(a, b) <= distance)
        label = _components(n, a[near], b[near], label)
    keep = ends - starts > 1
    first = np.stack([starts[keep], ends[keep], starts[keep], ends[keep], np.zeros(keep.sum(), dtype=np.int64)])
    waiting = [(bits - 1, first)]
    while waiting:
        bit, pairs = waiting.pop()
        if pairs.shape[1] > FRONTIER:
            waiting += [(bit, half) for half in np.array_split(pairs, 2, axis=1)]
            continue
        ul, uh, vl, vh, diff = pairs
        ones = np.concatenate([[0], np.cumsum((fps[:, (bits - 1 - bit) // 64] >> np.uint64(bit % 64)) & np.uint64(1)).astype(np.int64)])
        um, vm = uh - (ones[uh] - ones[ul]), vh - (ones[vh] - ones[vl])
        cross = ~((ul == vl) & (uh == vh))
        parts = [(ul, um, vl, vm, diff), (um, uh, vm, vh, diff), (ul, um, vm, vh, diff + 1), (um[cross], uh[cross], vl[cross], vm[cross], diff[cross] + 1)]
        ul, uh, vl, vh, diff = (np.concatenate(x) for x in zip(*parts))
        alive = (uh > ul) & (vh > vl) & (diff <= distance) & ~((ul == vl) & (uh - ul == 1))
        ul, uh, vl, vh, diff = ul[alive], uh[alive], vl[alive], vh[alive], diff[alive]
        leaves = (uh - ul == 1) & (vh - vl == 1)
        a, b = ul[leaves], vl[leaves]
        other = label[a] != label[b]
        a, b = a[other], b[other]
        near = apart(a, b) <= distance
        label = _components(n, a[near], b[near], label)
        changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        one = (changes[uh - 1] == changes[ul]) & (changes[vh - 1] == changes[vl]) & (label[ul] == label[vl])
        go = ~leaves & ~one
        if bit and go.any():
            waiting.append((bit - 1, np.stack([ul[go], uh[go], vl[go], vh[go], diff[go]])))
    return label


def _words(column: pa.ChunkedArray) -> np.ndarray:
    """Fingerprints, longs or bytes, as n x words."""
    if pa.types.is_integer(column.type):
        return column.to_numpy().view(np.uint64)[:, None]
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=">u8").reshape(len(rows), -1).astype(np.uint64)


def links(distinct: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """Spanning links (a, b) of the graph of fingerprints (fp, long) at most distance bits apart."""
    return bucket_links(distinct.select("fp", F.explode(_buckets(F.col("fp"), distance)).alias("x")).select("x.pair", "x.bits", "fp"), distance, block)


def bucket_links(buckets: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """Spanning links (a, b) of fingerprints that share one of buckets (pair, bits, fp; distinct) and are at most distance bits apart."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        key = [rows.column(c).to_numpy() for c in KEY]
        fps = _words(rows.column("fp"))
        order = np.lexsort((*fps.T[::-1], *key[::-1]))
        new = np.concatenate([[True], np.any([k[order][1:] != k[order][:-1] for k in key], axis=0)])
        size = np.diff(np.append(np.flatnonzero(new), len(fps)))
        many = np.repeat(size > 1, size)
        order, new = order[many], new[many]
        label = trie_links(fps[order], np.flatnonzero(new), distance) if len(order) else np.zeros(0, dtype=np.int64)
        far = np.flatnonzero(label != np.arange(len(label)))
        column = rows.column("fp").combine_chunks()
        # A label is the least index of its component, and fingerprints of a bucket are in order.
        a, b = column.take(pa.array(order[label[far]])), column.take(pa.array(order[far]))
        return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole buckets at a time: rows come sorted by bucket, and the last one of a batch waits for the next."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(c).to_numpy() for c in KEY]
            last = np.flatnonzero(np.any([k != k[-1] for k in key], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield solve(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif held and any(held[-1].column(c)[0].as_py() != int(k[0]) for c, k in zip(KEY, key)):
                yield solve(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield solve(pa.Table.from_batches(held))

    large = buckets.groupBy("pair", "bits").agg(F.count("*").alias("n")).where(F.col("n") > block).select("pair", "bits", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    cut = buckets.join(large, ["pair", "bits"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    cut = cut.select("pair", "bits", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cut = cut.select("pair", "bits", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    kind = buckets.schema["fp"].dataType.simpleString()
    return cut.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(run, f"a {kind}, b {kind}").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component. Alternates large and small star; each round is written and read again."""
    edges, before = materialize(edges.where("a <> b").distinct(), "edges"), None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("m").alias("a"), "b").distinct()
        up = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        root = up.groupBy("u").agg(F.min("v").alias("m"))
        small = up.join(root, "u").where("v <> m").select(F.least("m", "v").alias("a"), F.greatest("m", "v").alias("b"))
        edges = materialize(small.union(root.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now


def _named(marked: DataFrame, distinct: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of marked; distinct: (fp, least doc_id); found: links."""
    parts = connected_components(found)
    rooted = distinct.join(parts, distinct.fp == parts.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs; component_id is the smallest doc_id reachable over links."""
    marked = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    return _named(marked, distinct, links(distinct.select("fp"), distance))


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs, with links by similarity; fp holds 32 bytes."""

    def made(texts: list[str]) -> dict:
        found = [sketch(t, shingle) for t in texts]
        return {"fp": [f for f, _ in found], "keys": [k for _, k in found]}

    marked = materialize(map_texts(id_and_text(docs), made, "fp binary, keys array<bigint>"), "sketches")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    buckets = marked.select("fp", F.posexplode("keys").alias("pair", "bits")).select("pair", "bits", "fp").distinct()
    return _named(marked.select("doc_id", "fp"), distinct, bucket_links(buckets, budget(similarity)))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, fingerprint, component_id."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
