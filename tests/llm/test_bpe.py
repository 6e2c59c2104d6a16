"""Tree concatenation against the tokenizers library: exact ids, exact round trip."""

import hashlib
import random

import pytest

from candrank.llm.bpe import SPECIAL, bpe_digests, coder, leaves
from tests.conftest import DATA
from tests.llm.edge import ROWS, documents

PARTS = ["a", "th", "'s", "'ll", "'", "''", " ", "  ", "\n", "\t", "1", "23", "é", "ß", "!", "?", SPECIAL, "<|endof", "text|>", "re", "ab" * 30, " " * 40, "!" * 30, "\r\n", "　", "\U0001f600", "\x00"]


def digest(text):
    ids = coder().slow.encode(text, add_special_tokens=False).ids
    back = coder().slow.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


@pytest.mark.parametrize("most", [40, 64, 150])
def test_joined_halves_equal_the_whole(most):
    rnd = random.Random(most)
    for _ in range(400):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 300)))
        parts = leaves(text, most)
        assert "".join(parts) == text
        assert coder().tree([coder().leaf(p) for p in parts]) == coder().slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("unit", ["a", "ab", " ", "\n", "!", "1", "é", "<|endoftext|>", "x1"])
def test_unsplit_runs(unit):
    text = unit * 3000
    assert coder().tree([coder().leaf(p) for p in leaves(text, 500)]) == coder().slow.encode(text, add_special_tokens=False).ids


def test_both_libraries_agree_on_code_points():
    points = [x for x in range(0x30000) if not 0xD800 <= x < 0xE000]
    for at in range(0, len(points), 20_000):
        texts = [f"a{chr(x)}b1{chr(x)} {chr(x)}{chr(x)} !{chr(x)}?  {chr(x)}" for x in points[at : at + 20_000]]
        for text, e in zip(texts, coder().slow.encode_batch(texts, add_special_tokens=False)):
            assert coder().leaf(text) == e.ids


def test_query_on_edge_rows(spark):
    for leaf in (300, 32_768):
        got = sorted(((r.doc_id or -1, *r[1:]) for r in bpe_digests(documents(spark), leaf_chars=leaf).collect()))
        assert got == sorted((i or -1, *digest(t or "")) for i, t, *_ in ROWS)
    assert bpe_digests(documents(spark, [])).count() == 0


def test_query_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r[0]: tuple(r[1:]) for r in bpe_digests(docs, leaf_chars=2000).collect()}
    assert got == {i: digest(t or "") for i, t in docs.select("doc_id", "text").collect()}
