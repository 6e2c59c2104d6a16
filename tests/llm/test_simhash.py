import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from candrank.llm.registry import QUERIES
from candrank.llm.simhash import budget, connected_components, links, near_duplicates, similar_documents, simhash, sketch, trie_links
from tests.conftest import DATA
from tests.llm.edge import ROWS, documents


def plain(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, distance=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_query_on_documents(spark):
    texts = dict(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    ids = sorted(texts)
    fps = [plain(texts[i]) for i in ids]
    want = {i: (f"{f:016x}", ids[c]) for i, f, c in zip(ids, fps, components(fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op9_simhash_dedup"](spark, DATA).collect()} == want


def test_trie_finds_all_links():
    rnd = random.Random(9)
    seeds = [rnd.getrandbits(64) for _ in range(12)]
    fps = sorted({s ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 6))) & (2**64 - 1) for s in seeds for _ in range(40)})
    label = trie_links(np.array(fps, dtype=np.uint64), np.array([0]), 4)
    want = components(fps)
    assert len(set(zip(label.tolist(), want))) == len(set(want)) == len(set(label.tolist()))


def test_links_and_chains_over_buckets(spark):
    rnd = random.Random(1)
    fps, f = [], rnd.getrandbits(64)
    for _ in range(40):  # a chain whose ends are far apart
        fps.append(f)
        for b in rnd.sample(range(64), 4):
            f ^= 1 << b
    fps += [rnd.getrandbits(64) for _ in range(100)] + [0, 15, 31 << 40]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r.node: r.root for r in connected_components(links(df, 4)).collect()}
    want = components(fps)
    assert len({got.get(signed(x), signed(x)) for x in fps}) == len(set(want))
    assert len({got.get(signed(x), signed(x)) for x in fps[:40]}) == 1


def test_edge_rows(spark):
    got = sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in near_duplicates(documents(spark)).collect())
    first = {}
    for i, t, *_ in ROWS:
        first.setdefault(plain(t), i)
    assert got == sorted((str(i), plain(t), first[plain(t)]) for i, t, *_ in ROWS)
    assert near_duplicates(documents(spark, [])).count() == 0
    assert simhash("one two", 4) == plain("one two")


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def share(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_long_fingerprints_in_the_trie():
    rnd = random.Random(6)
    seeds = [rnd.getrandbits(256) for _ in range(9)]
    fps = sorted({s ^ sum(1 << b for b in rnd.sample(range(256), rnd.randint(0, 30))) for s in seeds for _ in range(30)})
    words = np.array([[f >> 64 * i & 2**64 - 1 for i in (3, 2, 1, 0)] for f in fps], dtype=np.uint64)
    label = trie_links(words, np.array([0]), 48)
    want = components(fps, 48)
    assert len(set(zip(label.tolist(), want))) == len(set(want)) == len(set(label.tolist()))


def test_a_large_bucket_is_cut_into_blocks(spark):
    rnd = random.Random(2)
    base = rnd.getrandbits(60)
    fps = sorted({base ^ sum(1 << b for b in rnd.sample(range(30), rnd.randint(0, 6))) for _ in range(300)})
    got = {r.node: r.root for r in connected_components(links(spark.createDataFrame([(x,) for x in fps], "fp long"), 4, block=20)).collect()}
    want = components(fps)
    assert len(set(zip([got.get(x, x) for x in fps], want))) == len(set(want)) == len({got.get(x, x) for x in fps})


def test_similar_documents_are_linked(spark):
    """Edits that leave a similarity of 0.8 or more; documents that share half of their text are not linked."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 9)))
    texts, same, apart = [], [], []
    for _ in range(150):
        words = [word() for _ in range(rnd.randint(60, 500))]
        other = list(words)
        while share(shingles(" ".join(words)), shingles(" ".join(other))) > 0.85:
            other[rnd.randrange(len(other))] = word()
        same.append((len(texts), len(texts) + 1))
        texts += [" ".join(words), " ".join(other)]
    for _ in range(150):
        half = [word() for _ in range(120)]
        apart.append((len(texts), len(texts) + 1))
        texts += [" ".join(half + [word() for _ in range(120)]) for _ in range(2)]
    out = {r.doc_id: r.component_id for r in similar_documents(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    pairs = [(i, j) for i, j in same if share(shingles(texts[i]), shingles(texts[j])) >= 0.8]
    assert len(pairs) > 100 and sum(out[i] == out[j] for i, j in pairs) >= 0.9 * len(pairs)
    assert not any(out[i] == out[j] for i, j in apart)
    assert 40 <= budget(0.8) <= 50 and len(sketch("", 5)[0]) == 32


def test_edge_rows_of_similar_documents(spark):
    got = sorted((str(r.doc_id), r.component_id) for r in similar_documents(documents(spark)).collect())
    first = {}
    for i, t, *_ in ROWS:
        first.setdefault(" ".join((t or "").split()), i)
    assert got == sorted((str(i), first[" ".join((t or "").split())]) for i, t, *_ in ROWS)
    assert similar_documents(documents(spark, [])).count() == 0
