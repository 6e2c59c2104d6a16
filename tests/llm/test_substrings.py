"""Against a search of every window."""

import random

import pytest

from candrank.llm import substrings
from candrank.llm.common import materialize
from candrank.llm.substrings import remove_repeats
from tests.conftest import DATA
from tests.llm.edge import ROWS, documents


def plain(rows, length=100):
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def got(df, **kw):
    return sorted(((*r[:4], bytes(r[4])) for r in remove_repeats(df, **kw).collect()), key=str)


def test_query_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert got(docs) == plain(sorted(docs.select("doc_id", "text").collect()))


@pytest.mark.parametrize("chunk,most", [(1 << 21, 100_000), (400, 100_000), (1 << 21, 3)])
def test_overlaps_runs_and_zero_bytes(spark, monkeypatch, chunk, most):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    monkeypatch.setattr(substrings, "_powers", {})
    rnd = random.Random(7)
    words = ["ab", "c", "\x00", "dé", "z" * 9, " ", "qq"]
    pool = ["".join(rnd.choice(words) for _ in range(60)) for _ in range(6)]
    rows = [(i, "".join(rnd.choice([*pool, rnd.choice(words) * 40, "".join(rnd.choice(words) for _ in range(30))]) for _ in range(rnd.randint(0, 6)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    df = materialize(df, "overlaps")
    assert got(df, length=50, k=18, most=most) == plain(rows, 50)


def test_edge_rows(spark):
    rows = sorted(ROWS, key=lambda r: -1 if r[0] is None else r[0])
    assert got(documents(spark)) == plain([r[:2] for r in rows])
    assert remove_repeats(documents(spark, [])).count() == 0


def test_equal_ids_and_equal_rows(spark, monkeypatch):
    """Different texts of one id are different documents; equal rows are one; nothing depends on how a scan deals rows."""
    from tests.llm.test_rows import redealt

    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    a, b = text(300), text(250)
    rows = [(1, a), (1, a), (2, b), (2, a + b), (3, text(400) + a)]
    monkeypatch.setattr(substrings.F, "monotonically_increasing_id", redealt)
    out = got(materialize(spark.createDataFrame(rows * 1, "doc_id long, text string").repartition(3), "equal"))
    assert [r for r in out if r[0] == 1] == [(1, 300, 0, 0, a.encode())] * 2
    assert sum(r[2] for r in out if r[0] == 2) == 550 and [r[2] for r in out if r[0] == 3] == [300]
