"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a lexicon of words and word beginnings learned from the labelled rows, lexicon words near the second person, capitals,
punctuation and obfuscated words. Trees and calibration are Spark ML models fitted on a bounded sample of labelled rows
(the least hashes of doc_id), the calibration on rows that the trees have not seen.

Defined results: null or empty text has features 0 and gets the model's score for them; a label above 0 is label 1; without
labelled rows of both kinds every score is the share of label 1 (0 if there is none); if the rows for the trees or those kept
aside hold one kind only, as with very few labels, both are fitted on all rows; equal rows give equal rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.llm.common import held_out, id_and_text, map_texts, materialize, table

SECOND_PERSON = frozenset("you your yours u ur ya du dich dir dein deine ihr euch tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»¡¿“”„…"
LEET = str.maketrans("013457@$!|", "oieastasil")
NOT_LETTER = re.compile(r"[\W\d_]+")
STEM = range(4, 9)
MARK = re.compile(r"[!?#*$%&|<>.,;:-]")
FEATURES = ["lexicon", "lexicon_hits", "lexicon_kinds", "near_you", "second_person", "upper", "shouted", "marks", "exclaimed", "obfuscated", "hidden", "log_words"]


@dataclass(frozen=True)
class ToxicParams:
    """max_labelled bounds the rows fitted; lexicon the number of words learned."""

    max_labelled: int = 20_000
    lexicon: int = 300
    min_documents: int = 5
    least_ratio: float = 8.0
    trees: int = 25
    depth: int = 3
    near: int = 5
    threshold: float = 0.7


def words_of(text: str) -> list[str]:
    return [w.strip(EDGE) for w in text.lower().split()]


def plain(word: str) -> str:
    """A disguised word without its disguise: digits and signs as the letters they stand for, separators dropped."""
    return NOT_LETTER.sub("", word.translate(LEET))


def features(text: str, lexicon: Lexicon, near: int) -> list[float]:
    raw = text.split()
    n, chars = max(1, len(raw)), max(1, len(text))
    words = words_of(text)
    odd = [(i, w) for i, w in enumerate(words) if w and not w.isalpha()]
    hits = [i for i, w in enumerate(words) if w in lexicon]
    hidden = [i for i, w in odd if w not in lexicon and plain(w) in lexicon]
    you = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON], dtype=np.int64)
    found = np.array(sorted(hits + hidden), dtype=np.int64)
    close = 0
    if len(you) and len(found):
        at = np.searchsorted(you, found)
        gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - found), np.abs(you[np.maximum(at - 1, 0)] - found))
        close = int((gap <= near).sum())
    mixed = sum(1 for _, w in odd if any(c.isalpha() for c in w))
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    return [
        len(found) / n, float(min(len(found), 10)), float(min(10, len({words[i] for i in hits}))), close / n, len(you) / n, upper / chars,
        sum(1 for w in raw if len(w) > 1 and w.isupper()) / n, len(MARK.findall(text)) / chars, text.count("!") / n, mixed / n, float(min(10, len(hidden))), float(np.log(n)),
    ]


def dense_features(docs: DataFrame, lexicon: frozenset[str], params: ToxicParams) -> DataFrame:
    """(doc_id and the features) for each row."""

    def made(texts: list[str]) -> dict:
        known = Lexicon(lexicon)
        rows = [features(t, known, params.near) for t in texts]
        return {name: [r[i] for r in rows] for i, name in enumerate(FEATURES)}

    return map_texts(id_and_text(docs), made, ", ".join(f"{name} double" for name in FEATURES))


def labelled_sample(docs: DataFrame, labels: DataFrame, params: ToxicParams) -> DataFrame:
    """(doc_id, text, toxic) of at most max_labelled rows that may be learned from."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.max_labelled)
    got = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return materialize(got.dropDuplicates(["doc_id"]), "toxic-sample")


def stems(word: str) -> list[str]:
    """The word as a whole (marked by $) and its beginnings: invented and inflected forms share the latter."""
    return [f"{word}$", *(word[:k] for k in STEM if k <= len(word))]


def learn_lexicon(sample: DataFrame, params: ToxicParams) -> frozenset[str]:
    """Stems that are at least params.least_ratio times as dense in toxic documents as in others, the best supported first.

    Each batch of documents adds up its stems before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[float]] = {}

        def out() -> pa.RecordBatch:
            columns = list(zip(*sums.values())) if sums else [[]] * 3
            made = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array(c, pa.float64()) for c in columns)], names=["stem", "documents", "toxic", "other"])
            sums.clear()
            return made

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = [w for w in words_of(text) if len(w) > 1]
                words += [plain(w) for w in words if not w.isalpha()]
                for stem, n in Counter(x for w in words for x in stems(w)).items():
                    s = sums.setdefault(stem, [0.0, 0.0, 0.0])
                    s[0] += toxic > 0
                    s[1 if toxic > 0 else 2] += n / len(words)
            if len(sums) > 400_000:
                yield out()
        yield out()

    n = dict(sample.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect())
    added = sample.select("text", "toxic").mapInArrow(run, "stem string, documents double, toxic double, other double")
    rows = added.groupBy("stem").agg(*(F.sum(c).alias(c) for c in ("documents", "toxic", "other"))).where(F.col("documents") >= params.min_documents)
    ratio = (F.col("toxic") / n[True]) / (F.col("other") / n[False] + 1e-5)
    rows = rows.where(ratio >= params.least_ratio).orderBy(F.desc(F.col("documents") * F.log(ratio)), "stem").limit(params.lexicon)
    return frozenset(r["stem"] for r in rows.collect())


class Lexicon:
    """Looks words up by their stems and remembers the answers, within bounds."""

    def __init__(self, entries: frozenset[str]):
        self.entries, self.known = entries, {}

    def __contains__(self, word: str) -> bool:
        hit = self.known.get(word)
        if hit is None:
            if len(self.known) > 200_000:
                self.known.clear()
            hit = self.known[word] = len(word) > 1 and not self.entries.isdisjoint(stems(word))
        return hit


def toxicity(docs: DataFrame, labels: DataFrame, params: ToxicParams = ToxicParams()) -> DataFrame:
    """(doc_id, score) for each row of docs."""
    sample = labelled_sample(docs, labels, params)
    counts = dict(sample.groupBy("toxic").count().collect())
    if len(counts) < 2:
        share = float(counts.get(1, 0) > 0)
        return docs.select("doc_id", F.lit(share).alias("score"))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    lexicon = learn_lexicon(sample, params)
    fitted = materialize(dense_features(sample, lexicon, params).join(sample.select("doc_id", F.col("toxic").cast("double").alias("label")), "doc_id"), "toxic-features")
    seen = F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(4)) > 0
    rows = assembler.transform(fitted).select("features", "label", seen.alias("seen")).coalesce(2).cache()
    apart = rows.select("seen", "label").distinct().count() == 4
    trees = GBTClassifier(maxIter=params.trees, maxDepth=params.depth, stepSize=0.3, seed=7).fit(rows.where("seen") if apart else rows)
    margin = lambda df: df.withColumn("margin", vector_to_array("probability")[1])
    aside = margin(trees.transform(rows.where("NOT seen") if apart else rows))
    steps = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="calibrated").fit(aside)
    rows.unpersist()
    scored = margin(trees.transform(assembler.transform(dense_features(docs, lexicon, params))))
    # Steps are flat: the margin keeps order within a step and moves a score by at most a hundredth.
    out = steps.transform(scored).withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.99 * F.col("calibrated") + 0.01 * F.col("margin"))))
    return out.select("doc_id", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, held_out, score, predicted."""
    params = ToxicParams()
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), params)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= params.threshold).cast("int").alias("predicted"))
