import numpy as np
import pytest
from pyspark.sql import functions as F

from candrank.llm import language
from candrank.llm.language import GRAMS, identify, infer, trigrams
from candrank.llm.registry import QUERIES
from tests.llm.edge import ROWS, documents

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    out = QUERIES["op5_language_id"](spark, DATA).join(docs, "doc_id").where("held_out AND lang IS NOT NULL")
    r = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.a > 0.97 and 0 <= r.lo and r.hi <= 1


def test_mixtures_and_edge_rows(spark):
    en, fr = "the quick brown fox jumps over the lazy dog and then it was gone ", "le renard brun saute par dessus le chien et puis il est parti vers la "
    base = [(i, en * 5, "en", "s") for i in range(100, 130)] + [(i, fr * 5, "fr", "s") for i in range(130, 160)]
    got = {r.doc_id: r for r in identify(documents(spark, base + ROWS + [(900, en * 20 + fr * 20, None, None), (901, en * 3, None, None), (902, "12 !! ½", None, None)])).collect()}
    assert got[901].lang_pred == "en" and {x.lang for x in got[901].languages} == {"en"}
    assert {x.lang for x in got[900].languages} == {"en", "fr"} and 0.3 < got[900].score < 0.7
    assert {got[i].lang_pred for i in (2, 3, 4, 902)} == {"und"} and got[2].score == 0.0
    assert len(got) == len({i for i, *_ in ROWS}) + 63
    assert {r.lang_pred for r in identify(documents(spark, [(4, "words here", None, None)])).collect()} == {"und"}
    assert identify(documents(spark, [])).count() == 0


@pytest.mark.parametrize("slice_", [1 << 20, 64])
def test_each_text_of_a_batch_is_scored_alone(monkeypatch, slice_):
    monkeypatch.setattr(language, "SLICE", slice_)
    made = {"en": "the quick brown fox jumps over the lazy dog ", "fr": "le renard brun saute par dessus le chien ", "ja": "これは日本語の文章です。狐が犬を飛び越えます。"}
    n = np.stack([np.bincount(trigrams(np.frombuffer(f" {t * 4} ".encode(), dtype=np.uint8)), minlength=GRAMS) for t in made.values()], axis=1)
    likelihoods = np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * GRAMS)).astype(np.float32)
    want = [("fox", 0), ("chien", 1), (made["ja"] * 9, 2), ("jumps", 0), ("狐が犬を飛び越えます", 2), ("dessus", 1), (made["en"] * 9, 0), (" \n renard  \n", 1), ("quick brown", 0), (made["fr"], 1)]
    texts = [f" {t} ".encode() for t, _ in want]
    together = infer(texts, likelihoods)
    assert together.argmax(axis=1).tolist() == [k for _, k in want]
    assert np.array_equal(together, np.concatenate([infer([t], likelihoods) for t in texts]))


MADE = {"de": "der schnelle braune fuchs springt über den faulen hund ", "en": "the quick brown fox jumps over the lazy dog ", "es": "el veloz zorro marrón salta sobre el perro perezoso ", "fr": "le renard brun saute par dessus le chien ", "it": "la volpe marrone salta sopra il cane pigro "}


def learned(made):
    n = np.stack([np.bincount(trigrams(np.frombuffer(f" {t * 4} ".encode(), dtype=np.uint8)), minlength=GRAMS) for t in made.values()], axis=1)
    return np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * GRAMS)).astype(np.float32)


def plain_words(text, table):
    """Likelihood of each word by language, trigram by trigram."""
    words, where = [], -1
    for i, c in enumerate(text):
        if i == 0 or (c <= 32 and text[i - 1] > 32 and any(b > 32 for b in text[i:])):
            words.append(np.zeros(table.shape[1]))
        a, b = (text[i - 1] if i else 0), (text[i - 2] if i > 1 else 0)
        code = (c * 83492791 ^ a * 19349663 ^ b * 73856093) & 0xFFFFFFFF
        words[-1] += table[(code ^ code >> 15) & GRAMS - 1]
    return np.array(words)


def plain_shares(text, table, penalty=2.0):
    """Expectation-maximisation and the choice of a set, word by word."""
    like = plain_words(text, table)

    def em(langs, rounds):
        share = {k: 1 / len(langs) for k in langs}
        for _ in range(rounds):
            got = dict.fromkeys(langs, 0.0)
            for w in like:
                p = {k: share[k] * np.exp(w[k] - w.max()) for k in langs}
                for k in langs:
                    got[k] += p[k] / max(sum(p.values()), 1e-300) / len(like)
            share = got
        return share, sum(np.log(max(sum(share[k] * np.exp(w[k] - w.max()) for k in langs), 1e-300)) + w.max() for w in like)

    n = table.shape[1]
    one = like.sum(axis=0)
    best, share = one.max(), {int(one.argmax()): 1.0}
    ordered = sorted(range(n), key=lambda k: -em(list(range(n)), 8)[0][k])
    for k in range(2, n + 1):
        s, total = em(ordered[:k], 6)
        if (total := total - penalty * (k - 1) * np.log(len(like) + 1)) > best:
            best, share = total, s
    return np.array([share.get(k, 0.0) for k in range(n)])


def test_shares_against_a_plain_mixture():
    table, made = learned(MADE), list(MADE.values())
    texts = [made[0] * 3 + made[1] * 2, made[2], "".join(t * 6 for t in made), "".join(t * 8 for t in made[:4]), "fox chien hund", made[4] * 5 + " 12 zorro \n \n"]
    got = infer([f" {t} ".encode() for t in texts], table)
    for g, t in zip(got, texts):
        assert np.allclose(g, plain_shares(f" {t} ".encode(), table), atol=1e-6)
    assert (got[2] > 0.05).all()  # five languages, none left out


@pytest.mark.parametrize("chunk", [2, 7, 50, 333])
def test_a_long_text_in_slices(chunk):
    table = learned(MADE)
    for t in ("".join(t * 6 for t in MADE.values()), " \n x", "chien" * 30, "a  b   \n\n"):
        text = f" {t} ".encode()
        assert np.allclose(infer([text], table, chunk=chunk), infer([text], table), atol=1e-9)
        assert np.allclose(np.concatenate(list(language.long_words(np.frombuffer(text, dtype=np.uint8), table, chunk))), plain_words(text, table), atol=1e-4)


def test_counts_of_trigrams_and_of_very_long_texts(spark):
    rows = [(i, t * (60_000 if i == 0 else 3), lang, "s") for i, (lang, t) in enumerate(MADE.items())]
    langs, table = language.fit_languages(documents(spark, [(3 * i, *r[1:]) for i, r in enumerate(rows) for i in range(40)]))
    assert langs == sorted(MADE) and table.shape == (GRAMS, 5)
    out = {r.doc_id: r.lang_pred for r in identify(documents(spark, [(3 * k + i * 200, t, lang, "s") for i, (_, t, lang, _) in enumerate(rows) for k in range(9)])).collect()}
    assert all(out[3 * k + i * 200] == lang for i, lang in enumerate(MADE) for k in range(9))
