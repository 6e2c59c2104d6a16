from candrank.llm.lines import TemplateParams, drop_recurring
from candrank.llm.registry import ORACLE_SQL, QUERIES
from tests.llm.edge import ROWS, documents


def test_query_equals_its_sql(same):
    same(QUERIES["op3_line_dedup"], ORACLE_SQL["op3_line_dedup"])


def test_templates_generalise_and_the_first_document_keeps_them(spark):
    rows = [(i, f"{chr(97 + i) * 5} {chr(97 + i) * 6} {chr(97 + i) * 7}\nPage {i} of report for user u{i} done\nthanks for reading all of {chr(97 + i)}q", "en", "s") for i in range(8)]
    got = {r.doc_id: r.text for r in drop_recurring(documents(spark, rows)).collect()}
    assert got[0] == rows[0][1]
    for i in range(1, 8):
        assert got[i] == rows[i][1].split("\n")[0]
    few = {r.doc_id: r.text for r in drop_recurring(documents(spark, rows[:4])).collect()}
    assert few == {i: t for i, t, *_ in rows[:4]}


def test_edge_rows(spark):
    out = drop_recurring(documents(spark), counts=("n_lines", "n_dropped"))
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted((str(i), str(t)) for i, t, *_ in ROWS)
    assert out.drop("n_lines", "n_dropped").columns == documents(spark).columns
    assert drop_recurring(documents(spark, [])).count() == 0
    again = drop_recurring(documents(spark, [(1, "one two three four", "en", "s")] * 9), TemplateParams(min_documents=2))
    assert {r.text for r in again.collect()} == {"one two three four"}  # one doc_id is one document


def test_short_lines_of_one_beginning_stay_and_short_lines_that_recur_go(spark):
    rows = [(i, f"One of the {chr(97 + i)}x things\nThe same short line", "en", "s") for i in range(9)]
    got = {r.doc_id: r.text for r in drop_recurring(documents(spark, rows)).collect()}
    assert got == {i: t if i == 0 else t.split("\n")[0] for i, t, *_ in rows}


def test_tokens_that_few_lines_of_a_leaf_share_are_not_fixed(spark):
    """Two ordinary words at later places recur in 6 of 60 different lines of one leaf: no template."""
    other = [f"q{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    rows = [(i, f"it was then {other[i]}a that very {other[i]}b" if i % 10 == 0 else f"it was then {other[i]}a {other[i]}c {other[i]}d {other[i]}b", "en", "s") for i in range(60)]
    assert {r.doc_id: r.text for r in drop_recurring(documents(spark, rows)).collect()} == {i: t for i, t, *_ in rows}


def test_names_that_clash_and_one_very_common_line(spark):
    docs = documents(spark, [(i, f"the very same line\n{'own ' * 4}{chr(97 + i % 26) * (2 + i // 26)}", "en", "s") for i in range(300)])
    for c in ("row", "places", "document", "salt", "__row", "__places", "__n_lines", "__n_dropped", "other_id"):
        docs = docs.withColumn(c, docs.lang)
    out = drop_recurring(docs)
    assert out.columns == docs.columns
    assert sum(r.text.startswith("the very same") for r in out.collect()) == 1


def test_very_long_tokens_and_very_many_lines_take_linear_time(spark):
    import time

    rows = [(i, "a short line that recurs\n" + ("x" * 5_000_000 + " 7 end" if i == 0 else "own"), "en", "s") for i in range(6)]
    many = "\n".join(w for k in range(250_000) for w in ("the very same line", f"line number {'abcdefghij'[k % 10]} {'q' * (k % 50)} of many"))
    began = time.time()
    got = {r.doc_id: r.text for r in drop_recurring(documents(spark, rows)).collect()}
    assert got[0] == rows[0][1] and all(got[i] == "own" for i in range(1, 6))
    rows = [(9, many, "en", "s")] + [(i, "the very same line", "en", "s") for i in range(8)]
    out = {r.doc_id: (r.n, r.dropped, r.text) for r in drop_recurring(documents(spark, rows), counts=("n", "dropped")).collect()}
    assert out[9][:2] == (500_000, 250_000) and out[9][2] == many.replace("the very same line\n", "") and out[0][2] == "the very same line"
    assert time.time() - began < 150
