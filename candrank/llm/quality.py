"""Quality rules: text statistics and a learned decision list, all in Spark expressions.

Sequential covering grows conjunctions of thresholds on part of the labelled rows, prunes them on the rest, and emits
the rules as one ordered CASE expression. Nothing but DataFrame functions touches the documents.

Defined results: null or empty text has no words and fails the base rules; lines without a word never count as
repeated; equal rows give equal results; a table without labelled rows learns no rule, so the base rules decide.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.llm.common import WORD_BREAK, table

WINDOW = 8
SYMBOLS = "#*$%&|<>"
FEATURES = ["mean_word", "symbols", "upper", "digits", "marks", "dup_lines", "repeats", "distinct_words", "words_a_line", "log_words"]


@dataclass(frozen=True)
class CoverParams:
    """max_labelled bounds the rows that are fitted (documented sample: the least hashes of doc_id)."""

    max_labelled: int = 20_000
    thresholds: int = 40
    max_conditions: int = 3
    max_rules: int = 12
    min_precision: float = 0.9
    min_cover: int = 5


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeat_words(hashes: Column) -> Column:
    """Words under those windows whose hash occurs twice or more; hashes are in text order."""
    n = F.size(hashes)
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(hashes)) < n, ordered)


def text_statistics(docs: DataFrame, carried: str = "doc_id") -> DataFrame:
    """(carried, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the features) for each row of docs; carried is a column of docs."""
    text = F.col("text")
    base = docs.select(carried, F.coalesce("text", F.lit("")).alias("text")).select(
        carried,
        "text",
        F.filter(F.split(text, f"{WORD_BREAK}+"), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0).alias("lines"),
    )
    base = base.select(
        carried,
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - _without(text, " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        _without(text, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        _without(text, "0123456789").alias("n_digits"),
        _without(text, "!?.,;:|#*$%&<>-_=").alias("n_marks"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.when(F.size("words") >= WINDOW, F.transform("words", lambda w: F.xxhash64(w))).alias("hashes"),
    )
    for step in (1, 2, 4):  # hashes of 2, 4, then WINDOW words; a slice for each window would copy the whole array each time
        n = F.size("hashes") - step
        base = base.withColumn("hashes", F.zip_with(F.slice("hashes", 1, n), F.slice("hashes", step + 1, n), lambda a, b: F.xxhash64(a, b)))
    base = base.withColumn("ordered", _repeat_words(F.col("hashes"))).drop("hashes")
    before, after = F.slice("ordered", 1, F.size("ordered") - 1), F.slice("ordered", 2, F.size("ordered") - 1)
    none = F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("int").alias("p")))
    met = F.filter(
        F.arrays_zip(F.concat(none, before).alias("a"), F.col("ordered").alias("b"), F.concat(after, none).alias("c")),
        lambda x: F.coalesce(x["a"]["h"] == x["b"]["h"], F.lit(False)) | F.coalesce(x["c"]["h"] == x["b"]["h"], F.lit(False)),
    )
    base = base.withColumn("places", F.when(F.col("ordered").isNotNull(), F.array_sort(F.transform(met, lambda x: x["b"]["p"])))).drop("ordered")
    steps = F.zip_with(F.slice("places", 2, F.size("places") - 1), F.slice("places", 1, F.size("places") - 1), lambda b, a: F.least(F.lit(WINDOW), b - a))
    covered = F.when(F.col("places").isNotNull(), F.aggregate(steps, F.lit(WINDOW), lambda s, x: s + x)).otherwise(F.lit(0))
    # A filter on the result must not be pushed below this point: each step down would write these expressions out
    # again for every use. A column that counts as not deterministic, though its value is, holds it here.
    base = base.withColumn("n_repeat_words", F.when(F.monotonically_increasing_id() >= 0, covered.cast("long"))).drop("places")
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    words = F.greatest(F.col("n_words"), F.lit(1))
    return base.select(
        carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / words).alias("mean_word"),
        (F.col("n_symbols") / chars).alias("symbols"),
        (F.col("n_upper") / chars).alias("upper"),
        (F.col("n_digits") / chars).alias("digits"),
        (F.col("n_marks") / chars).alias("marks"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_lines"),
        (F.col("n_repeat_words") / words).alias("repeats"),
        (F.col("n_distinct") / words).alias("distinct_words"),
        (F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1))).alias("words_a_line"),
        F.log(words.cast("double")).alias("log_words"),
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
    )


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    from math import log2

    return p1 * (log2(p1 / (p1 + n1)) - log2(p0 / (p0 + n0))) if p1 else -1.0


def learn_rules(rows: list[tuple[list[float], bool]], params: CoverParams) -> list[tuple[list[tuple[str, str, float]], float]]:
    """Ordered rules ([(feature, '<=' or '>', threshold)], precision) that reject; rows: (features, is bad).

    Row sets are integers used as bit masks: growing tries every threshold on the rows left, pruning drops trailing
    conditions while the precision on rows kept aside does not fall.
    """
    conditions: dict[tuple[str, str, float], int] = {}
    for j, name in enumerate(FEATURES):
        values = sorted({x[j] for x, _ in rows})
        cuts = values if len(values) <= params.thresholds else [values[len(values) * i // params.thresholds] for i in range(1, params.thresholds)]
        ordered = sorted(range(len(rows)), key=lambda i: rows[i][0][j])
        mask, k, everything = 0, 0, (1 << len(rows)) - 1
        for cut in cuts:
            while k < len(ordered) and rows[ordered[k]][0][j] <= cut:
                mask |= 1 << ordered[k]
                k += 1
            conditions[name, "<=", cut], conditions[name, ">", cut] = mask, everything & ~mask
    bad = sum(1 << i for i, (_, y) in enumerate(rows) if y)
    aside = sum(1 << i for i in range(2, len(rows), 3))
    everything = (1 << len(rows)) - 1
    left, rules = everything, []
    while len(rules) < params.max_rules:
        grow, prune = left & ~aside, left & aside
        rule: list[tuple[str, str, float]] = []
        at = grow
        while len(rule) < params.max_conditions and (at & ~bad):
            p0, n0 = (at & bad).bit_count(), (at & ~bad).bit_count()
            if not p0:
                break
            best = max(conditions, key=lambda c: _gain(p0, n0, (at & conditions[c] & bad).bit_count(), (at & conditions[c] & ~bad).bit_count()))
            if best in rule or _gain(p0, n0, (at & conditions[best] & bad).bit_count(), (at & conditions[best] & ~bad).bit_count()) <= 0:
                break
            rule.append(best)
            at &= conditions[best]

        def precision(r: list, within: int) -> tuple[float, int]:
            for c in r:
                within &= conditions[c]
            n = within.bit_count()
            return ((within & bad).bit_count() / n if n else 0.0), n

        while len(rule) > 1 and precision(rule[:-1], prune)[0] >= precision(rule, prune)[0]:
            rule.pop()
        good, n = precision(rule, left)
        if not rule or n < params.min_cover or good < params.min_precision:
            break
        rules.append((rule, good))
        for_rule = everything
        for c in rule:
            for_rule &= conditions[c]
        left &= ~for_rule
    return rules


def fit_decision_list(docs: DataFrame, labels: DataFrame, params: CoverParams = CoverParams()) -> list:
    """Rules from at most params.max_labelled labelled documents that pass the base rules."""
    sample = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.max_labelled)
    )
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    stats = text_statistics(chosen).where(~F.col("base_failed")).dropDuplicates(["doc_id"])
    got = stats.join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").select(*FEATURES, "quality").limit(params.max_labelled).collect()
    return learn_rules([([float(v) for v in r[:-1]], r[-1] == 0) for r in got], params)


def verdict(rules: list) -> Column:
    """The rules as one ordered conditional expression: false at the first rule that holds, else true."""
    out = None
    for rule, _ in rules:
        held = F.lit(True)
        for name, op, cut in rule:
            held = held & (F.col(name) <= cut if op == "<=" else F.col(name) > cut)
        out = F.when(held, False) if out is None else out.when(held, False)
    return F.lit(True) if out is None else out.otherwise(True)


def quality_rules(docs: DataFrame, labels: DataFrame, params: CoverParams = CoverParams()) -> DataFrame:
    """Statistics, base rules and the learned verdict for each row of docs."""
    rules = fit_decision_list(docs, labels, params)
    return text_statistics(docs).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, labels: DataFrame, params: CoverParams = CoverParams()) -> DataFrame:
    """The rows of docs that the rules keep, unchanged."""
    rules = fit_decision_list(docs, labels, params)
    rows = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__document"))
    judged = text_statistics(rows, "__document").withColumn("__kept", ~F.col("base_failed") & verdict(rules))
    return judged.where("__kept").select("__document.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, n_words, four counts, base_failed, kept."""
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
