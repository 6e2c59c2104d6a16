import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from candrank.llm.registry import QUERIES
from candrank.llm.toxicity import FEATURES, SECOND_PERSON, Lexicon, ToxicParams, dense_features, features, learn_lexicon, plain, toxicity
from tests.llm.edge import ROWS, documents, labels

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    out = QUERIES["op10_toxicity"](spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out AND toxic IS NOT NULL")
    n = {(r.toxic, r.predicted): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert n.get((0, 1), 0) <= 0.02 * n[0, 0] and n.get((1, 1), 0) >= 2 * n.get((1, 0), 0)
    r = out.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert 0 <= r.lo <= r.hi <= 1


def test_features():
    f = features("You are a st00pid st0opid IDIOT!", Lexicon(frozenset({"stoopid$", "idiot$"})), 5)
    assert f[0] > 0.4 and f[3] > 0.4 and f[10] == 2.0 and plain("1d.i0t") == "idiot"
    assert features("", Lexicon(frozenset()), 5)[:11] == [0.0] * 11


def test_edge_rows(spark):
    assert {r.score for r in toxicity(documents(spark), labels(spark)).collect()} == {0.0}
    made = [(i, f"you are a {'stupid loser' if i % 2 else 'kind person'} and that is number {i} of them", "en", "s") for i in range(1000, 1200)]
    told = labels(spark, [(i, 1, i % 2, "x", 0) for i in range(1000, 1200)] + [(1001, 1, 1, None, None), (None, None, 1, None, None), (1, 1, None, None, None)])
    got = toxicity(documents(spark, made + ROWS), told).collect()
    assert len(got) == 200 + len(ROWS)
    score = {r.doc_id: r.score for r in got}
    assert all((score[i] > 0.7) == bool(i % 2) for i in range(1000, 1200)) and score[2] < 0.5
    assert toxicity(documents(spark, []), told).count() == 0


def plain_features(text, lexicon, near=5):
    """The features again, word by word; lexicon holds whole words."""
    raw = (text or "").split()
    words = [re.sub(r"^[^\w]+|[^\w]+$", "", w.lower()) for w in raw]
    clear = lambda w: "".join(c for c in w.translate(str.maketrans("013457@$!|", "oieastasil")) if c.isalpha())
    hit = [i for i, w in enumerate(words) if w in lexicon]
    hidden = [i for i, w in enumerate(words) if w and not w.isalpha() and w not in lexicon and clear(w) in lexicon]
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    found, n, chars = hit + hidden, max(1, len(raw)), max(1, len(text or ""))
    return [
        len(found) / n, min(10, len(found)), min(10, len({words[i] for i in hit})), sum(any(abs(i - j) <= near for j in you) for i in found) / n, len(you) / n,
        sum(c.isupper() for c in text or "") / chars, sum(len(w) > 1 and w.isupper() for w in raw) / n, sum(c in "!?#*$%&|<>.,;:-" for c in text or "") / chars,
        (text or "").count("!") / n, sum(any(c.isalpha() for c in w) and not w.isalpha() for w in words if w) / n, min(10, len(hidden)), np.log(n),
    ]


def test_features_against_a_plain_count(spark):
    lexicon = {"idiot", "loser", "stupid"}
    texts = ["You are a st0pid id1ot , LOSER!!", "kind words and more", None, "", "!!! ??", "your l0ser far away from it all and on and on idiot", "A-B c3po YOU stupid", "x " * 3000 + "you stupid"]
    made = dense_features(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), frozenset(f"{w}$" for w in lexicon), ToxicParams())
    got = {r.doc_id: [r[c] for c in FEATURES] for r in made.collect()}
    for i, t in enumerate(texts):
        assert np.allclose(got[i], plain_features(t, lexicon)), (t, got[i], plain_features(t, lexicon))


def test_lexicon_against_a_plain_count(spark):
    rows = [(i, f"{'vile brute' if i % 3 == 0 else 'nice friend'} of mine number {'abcdefghij'[i % 10] * 3}", int(i % 3 == 0)) for i in range(60)]
    got = learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), ToxicParams())
    assert {"vile$", "brute$", "brut"} <= got and not {"nice$", "mine$", "number$", "of$"} & got


@pytest.mark.parametrize("n", [(1, 1), (2, 1), (1, 5), (3, 3)])
def test_very_few_labels(spark, n):
    ids = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 3 != 1][: sum(n)]
    docs = documents(spark, [(i, f"you {'awful brute' if k < n[0] else 'kind friend'}", "en", "s") for k, i in enumerate(ids)] + [(5, "nothing", "en", "s"), (6, None, "en", "s")])
    got = toxicity(docs, labels(spark, [(i, 1, 1 + k % 2 if k < n[0] else 0, "x", 0) for k, i in enumerate(ids)])).collect()
    assert len(got) == sum(n) + 2 and all(0 <= r.score <= 1 for r in got)


def test_scores_are_shares(spark):
    """Of texts that look alike a known share has label 1: scores lie near it, though the trees alone push towards 0 and 1."""
    rnd = random.Random(3)
    rows = [(i, f"{['kind friend', 'awful brute'][i % 2]} you are {'abcdefghij'[i // 2 % 10] * 4} today", "en", "s") for i in range(2000, 4000)]
    told = [(i, 1, int(rnd.random() < (0.01, 0.92)[i % 2]), "x", 0) for i in range(2000, 4000)]
    out = toxicity(documents(spark, rows), labels(spark, told)).collect()
    means = [np.mean([r.score for r in out if r.doc_id % 2 == kind]) for kind in range(2)]
    assert abs(means[0] - 0.01) < 0.03 and abs(means[1] - 0.92) < 0.04
