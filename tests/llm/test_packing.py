import zlib
from collections import defaultdict

import numpy as np
import pytest

from candrank.llm.bpe import coder
from candrank.llm.packing import END_ID, best_fit, fit_repeats, full_patterns, pack, plan, round_repeats
from tests.conftest import DATA
from tests.llm.edge import ROWS, documents


def check(rows, texts, size):
    """texts: (doc_id, text); rows that share a doc_id must hold equal texts."""
    copies, pieces, sequences = defaultdict(int), defaultdict(list), defaultdict(list)
    ids = {}
    for i, t in texts:
        copies[i] += 1
        ids[i] = [*coder().slow.encode(t or "", add_special_tokens=False).ids, END_ID]
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        first = (len(x) - 1) % size + 1
        cuts = [0, *range(first, len(x) + 1, size)]
        want = [(k, a, b - a, zlib.crc32(np.array(x[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted(pieces[i]) == sorted(want * copies[i])
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences), sum(len(ids[i]) * n for i, n in copies.items()) / size


def test_query_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    used, least = check(pack(docs).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()], 1024)
    assert used <= 1.05 * least + 2


@pytest.mark.parametrize("size", [8, 1024])
def test_edge_rows(spark, size):
    check(pack(documents(spark), size).collect(), [r[:2] for r in ROWS], size)
    assert pack(documents(spark, []), size).count() == 0


def test_repeats_fit_the_histogram():
    p = full_patterns(32)
    true = np.zeros(len(p))
    true[[3, 17, 40]] = 50, 20, 9
    h = sum(np.bincount(p[:, i], weights=true, minlength=33) for i in range(3))
    h[0] = 0
    x = fit_repeats(p, h, 2000)
    made = sum(np.bincount(p[:, i], weights=x, minlength=33) for i in range(3))
    made[0] = 0
    assert (x >= 0).all() and np.abs(made - h).sum() < 0.02 * h.sum()
    lengths, ranks, sequences, offsets = plan({k: int(v) for k, v in enumerate(h) if v}, 32)
    assert (np.diff(lengths * 1000 + ranks) > 0).all()


def test_best_fit_wastes_little():
    h = np.zeros(101, dtype=np.int64)
    h[[30, 40, 70, 60, 100]] = 5, 4, 5, 4, 3
    assert sum(n for _, n in best_fit(h, 100)) == 12


def test_patterns_cost_no_sequence():
    """A histogram like that of prose: patterns hold most of the pieces, and no more sequences than best fit alone."""
    rnd = np.random.default_rng(4)
    lengths = np.clip(np.exp(rnd.normal(5.9, 0.9, 60_000)).astype(int), 1, 5000)
    h = np.bincount((lengths - 1) % 1024 + 1, minlength=1025)
    h[1024] += ((lengths - 1) // 1024).sum()
    p, left = full_patterns(1024), h.copy()
    made = round_repeats(p, fit_repeats(p, h), left)
    used = sum(n for _, n in made + best_fit(left.copy(), 1024))
    assert sum(len(x) * n for x, n in made) > 0.5 * h[:1024].sum()
    assert (h * np.arange(1025)).sum() / 1024 <= used <= sum(n for _, n in best_fit(h.copy(), 1024))
