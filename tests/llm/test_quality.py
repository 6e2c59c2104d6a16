import math
import random
import re
from collections import Counter

from candrank.llm.quality import CoverParams, FEATURES, fit_decision_list, keep_good, learn_rules, quality_rules, text_statistics
from candrank.llm.registry import QUERIES
from tests.conftest import DATA
from tests.llm.edge import ROWS, documents, labels


def plain(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    under = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(under), len(w) < 20 or 100 * len(under) > 30 * len(w)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_query_on_documents(spark):
    texts = dict(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    out = QUERIES["op7_quality_rules"](spark, DATA).collect()
    assert len(out) == len(texts)
    for r in out:
        assert tuple(r[c] for c in COLUMNS) == plain(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_plan_is_native(spark):
    plan = QUERIES["op7_quality_rules"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_rules_from_labels(spark):
    out = QUERIES["op7_quality_rules"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("NOT base_failed")
    n = {(r.quality, r.kept): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.02 * n[1, True] and n.get((0, True), 0) <= 0.2 * n[0, False]


def test_covering_learns_and_stays_silent():
    row = lambda symbols, bad: ([0.0, symbols] + [0.0] * (len(FEATURES) - 2), bad)
    rules = learn_rules([row(i / 100, i >= 80) for i in range(100)], CoverParams())
    assert rules[0][0][0][:2] == ("symbols", ">")
    assert learn_rules([row(i % 7, i % 2 == 0) for i in range(100)], CoverParams()) == [] and learn_rules([], CoverParams()) == []


def test_edge_rows(spark):
    got = sorted((str(r.doc_id), *(r[c] for c in COLUMNS)) for r in text_statistics(documents(spark)).collect())
    assert got == sorted((str(i), *plain(t)) for i, t, *_ in ROWS)
    assert quality_rules(documents(spark), labels(spark)).where("kept").count() == 2
    kept = keep_good(documents(spark), labels(spark, [(1, 1, 0, "x", 1), (1, 0, None, None, None), (None, None, None, None, None)]))
    assert kept.columns == documents(spark).columns
    assert keep_good(documents(spark, []), labels(spark)).count() == 0


def holds(rule, x):
    return all(x[FEATURES.index(f)] <= cut if op == "<=" else x[FEATURES.index(f)] > cut for f, op, cut in rule)


def plain_cover(rows, params):
    """Sequential covering over lists of rows: grow on two thirds, prune on the rest, stop at the first weak rule."""
    cuts = {}
    for j, name in enumerate(FEATURES):
        values = sorted({x[j] for x, _ in rows})
        cuts[name] = values if len(values) <= params.thresholds else [values[len(values) * i // params.thresholds] for i in range(1, params.thresholds)]
    tests = [(f, op, cut) for f in FEATURES for cut in cuts[f] for op in ("<=", ">")]

    def gain(rows, more):
        p0, n0, p1, n1 = (sum(y == v for _, y in r) for r in (rows, more) for v in (True, False))
        return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else -1.0

    precision = lambda rule, rows: (lambda got: sum(got) / len(got) if got else 0.0)([y for x, y in rows if holds(rule, x)])
    left, out = [(i, r) for i, r in enumerate(rows)], []
    while len(out) < params.max_rules:
        grow, prune = ([r for i, r in left if (i % 3 == 2) == aside] for aside in (False, True))
        rule, at = [], grow
        while len(rule) < params.max_conditions and any(not y for _, y in at) and any(y for _, y in at):
            best = max(tests, key=lambda t: gain(at, [r for r in at if holds([t], r[0])]))
            if best in rule or gain(at, [r for r in at if holds([best], r[0])]) <= 0:
                break
            rule.append(best)
            at = [r for r in at if holds([best], r[0])]
        while len(rule) > 1 and precision(rule[:-1], prune) >= precision(rule, prune):
            rule.pop()
        covered = [r for _, r in left if rule and holds(rule, r[0])]
        if len(covered) < params.min_cover or precision(rule, covered) < params.min_precision:
            break
        out.append(rule)
        left = [(i, r) for i, r in left if not holds(rule, r[0])]
    return out


def test_covering_against_plain_lists():
    rnd = random.Random(4)
    for k in range(6):
        rows = []
        for _ in range(120):
            x = [round(rnd.random(), 1 + k % 2) for _ in FEATURES]
            rows.append((x, (x[1] > 0.6 and x[3] <= 0.7) or x[7] > 0.9 or rnd.random() < 0.02 * k))
        params = CoverParams(thresholds=12)
        assert [rule for rule, _ in learn_rules(rows, params)] == plain_cover(rows, params)


def test_kept_follows_the_list(spark):
    """The CASE expression over all documents, against the learned rules applied one after another."""
    docs, told = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rules = fit_decision_list(docs, told)
    assert rules
    want = {r.doc_id: not r.base_failed and not any(holds(rule, [r[f] for f in FEATURES]) for rule, _ in rules) for r in text_statistics(docs).collect()}
    assert {r.doc_id: r.kept for r in quality_rules(docs, told).collect()} == want and set(want.values()) == {True, False}
