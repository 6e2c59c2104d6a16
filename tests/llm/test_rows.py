"""Results that must not depend on how a scan deals rows to partitions."""

import random

from pyspark.sql.functions import udf

import corpus_pipeline as P
from candrank.llm.lines import drop_recurring
from tests.llm.edge import documents


def redealt():
    """In place of monotonically_increasing_id, as if each scan had other partitions: other ids whenever it is evaluated."""
    return udf(lambda: random.SystemRandom().getrandbits(50), "long").asNondeterministic()()


def rows():
    return [(i, f"thanks for reading all of it\nonly in number {chr(97 + i)} {chr(98 + i)} {chr(99 + i)} {'word' * (i + 1)}", "en", "s") for i in range(12)] * 2 + [(None, "thanks for reading all of it", "en", "s")]


def test_lines(spark, monkeypatch):
    import candrank.llm.lines as module

    docs = documents(spark, rows())
    want = sorted((str(r.doc_id), r.text, r["dropped"]) for r in drop_recurring(docs, counts=("lines", "dropped")).collect())
    monkeypatch.setattr(module.F, "monotonically_increasing_id", redealt)
    assert sorted((str(r.doc_id), r.text, r["dropped"]) for r in drop_recurring(docs, counts=("lines", "dropped")).collect()) == want
    assert sum(n for _, _, n in want) == 2 * 11 + 1


def test_near(spark, monkeypatch):
    docs = documents(spark, rows())
    want = sorted((str(r.doc_id), r.text) for r in P.near(spark, docs, None).collect())
    monkeypatch.setattr(P.F, "monotonically_increasing_id", redealt)
    assert want and sorted((str(r.doc_id), r.text) for r in P.near(spark, docs, None).collect()) == want
