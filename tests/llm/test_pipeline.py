"""The stages, each on the one before's output, against what each must keep."""

import corpus_pipeline as P
from candrank.llm.common import materialize, table
from candrank.llm.secrets import base_spans
from tests.conftest import DATA
from tests.llm.edge import documents
from tests.llm.test_quality import plain as statistics
from tests.llm.test_simhash import share, shingles


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns, before, after = docs.columns, {}, {r.doc_id: r for r in docs.collect()}
    made = {}
    for name, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, DATA), name)
        assert docs.columns == columns
        before, after = after, {r.doc_id: r for r in docs.collect()}
        assert after.keys() <= before.keys() and all(r.n_chars == len(r.text or "") for r in after.values())
        made[name] = before, after
    b, a = made["quality"]
    assert not any(statistics(r.text)[-1] for r in a.values()) and all(a[i] == b[i] for i in a)
    assert not {i for i in b if i not in a and not statistics(b[i].text)[-1] and statistics(b[i].text)[2] == statistics(b[i].text)[3] == 0 and "!!" not in b[i].text}
    b, a = made["lines"]
    assert a.keys() == b.keys() and all(set((a[i].text or "").split("\n")) <= {*(b[i].text or "").split("\n"), ""} for i in a)
    b, a = made["near"]
    sets = {i: shingles(b[i].text) for i in b}
    alike = {i: {j: share(sets[i], sets[j]) for j in b if j != i and 2 * len(sets[i] & sets[j]) >= len(sets[i])} for i in b}
    assert not [(i, j) for i in a for j, x in alike[i].items() if x >= 0.8 and j in a]  # of those alike one stays
    assert all(any(x >= 0.6 and j < i for j, x in alike[i].items()) or not sets[i] for i in b if i not in a)  # and nothing else goes
    assert len({i for i in b if any(x >= 0.8 for x in alike[i].values())} - set(a)) > 5
    b, a = made["secrets"]
    assert a.keys() == b.keys() and not any(base_spans(r.text or "") for r in a.values())
    assert all(a[i].text == b[i].text or "[SECRET]" in a[i].text for i in a)
    out = P.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in out} == set(a)


def test_edge_rows(spark):
    docs = documents(spark)
    for name, stage in P.STAGES:
        docs = materialize(stage(spark, docs, DATA), name)
    assert docs.count() > 0
    docs = documents(spark, [])
    for name, stage in P.STAGES:
        docs = materialize(stage(spark, docs, DATA), name)
    assert docs.count() == 0


def test_columns_of_any_name_go_through(spark):
    docs = documents(spark)
    names = ["__row", "__places", "__n_lines", "__n_dropped", "__kept", "__document", "document", "found", "Found_", "keys", "row", "salt", "leaf", "words", "text2", "a b", "x.y"]
    for c in names:
        docs = docs.withColumn(c, docs.source)
    docs = materialize(docs, "names")
    for name, stage in P.STAGES[:-1]:
        out = materialize(stage(spark, docs, DATA), name)
        assert out.columns == docs.columns, name
        docs = out
    assert docs.count() > 0 and P.STAGES[-1][1](spark, docs, DATA).count() > 0


def test_stages_are_the_five_in_order():
    assert [name for name, _ in P.STAGES] == ["quality", "lines", "near", "secrets", "packing"]
