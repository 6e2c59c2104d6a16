"""Lines under headers across splits, documents of mixed types, functions in SQL text, coverage and flag summaries."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from candrank.functions import sql
from candrank.functions.exprs import num
from candrank.operators import candidates, depth, report
from candrank.operators.groups import grouped_records, running_groups
from candrank.sources.readers import keyed_variant, read_fasta, with_ordinal


@pytest.fixture
def small_splits(spark):
    """Files are cut every 200 bytes, and splits of several files share a task."""
    keys = {"spark.sql.files.maxPartitionBytes": "200b", "spark.sql.files.openCostInBytes": "1b"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def write_fasta_files(tmp_path, mark=">", newline="\n"):
    rnd = random.Random(6)
    for name in "abc":
        records = [f"{mark}{name}{k} of {rnd.randint(0, 9)}" + "".join(newline + "".join(rnd.choice("ACGT ") for _ in range(rnd.randint(0, 60))) for _ in range(rnd.choice([0, 1, 3, 12]))) for k in range(rnd.randint(1, 25))]
        (tmp_path / f"{name}.fa").write_text(("before any header" + newline if name == "b" else "") + newline.join(records) + newline, newline="")


def test_groups_over_splits_equal_the_record_splitter(spark, tmp_path, small_splits):
    write_fasta_files(tmp_path)
    lines = with_ordinal(spark.read.text(str(tmp_path)))
    assert lines.select("ordinal.file_path", "ordinal.file_block_start").distinct().count() > 15
    key = lambda df: sorted(tuple(r) for r in df.select("id", "header", "seq").collect())
    got = key(grouped_records(lines))
    assert got == key(read_fasta(spark, str(tmp_path))) and len(got) > 15
    order = [r.header for r in grouped_records(lines).orderBy("ordinal").collect()]
    plain = [line[1:].strip() for name in "abc" for line in (tmp_path / f"{name}.fa").read_text().splitlines() if line.startswith(">")]
    assert order == plain


def test_groups_where_no_separator_can_cut(spark, tmp_path, small_splits):
    """Two marks, blanks before them, and ends of lines of two characters."""
    write_fasta_files(tmp_path, mark=" >", newline="\r\n")
    (tmp_path / "z.fa").write_text("".join(f";z{k}\n{'AC' * k}\nGT\n" for k in range(40)))
    (tmp_path / "empty.fa").write_text("")
    (tmp_path / "none.fa").write_text("ACGT\n" * 50)
    lines = with_ordinal(spark.read.text(str(tmp_path)))
    got = {r.id: r.seq for r in grouped_records(lines, r"^\s*[>;]").collect()}
    want = {}
    for path in tmp_path.glob("*.fa"):
        for line in path.read_text().splitlines():
            if line.strip()[:1] in (">", ";"):
                at = line.strip()[1:].split()[0]
                want[at] = ""
            elif path.name[0] not in "n" and not (path.name == "b.fa" and line == "before any header"):
                want[at] += line.strip()
    assert got == want and "z39" in got
    under = running_groups(lines, F.col("value").rlike(r"^\s*[>;]"))
    assert under.count() == lines.count() and under.where("number = 0").where("header IS NOT NULL").isEmpty()
    assert under.where("number = 0").count() == 50 + 1


def test_groups_are_counted_without_a_sort_of_lines(spark, tmp_path, small_splits):
    """Neither summaries of splits nor lines under a header sort what a task reads, and lines are not shuffled to meet what their split begins with."""
    write_fasta_files(tmp_path)
    lines = with_ordinal(spark.read.text(str(tmp_path)))
    under = running_groups(lines, F.col("value").rlike("^>"))
    same = under.groupBy("ordinal.file_path", "number").agg(F.collect_set("header").alias("h"), F.collect_set("head").alias("n"), F.min("ordinal.n").alias("first")).where("number > 0").collect()
    assert len(same) > 15 and all(len(r.h) == 1 and r.n == [r.first] for r in same)
    counted = under.groupBy("head", "header").agg(F.count("*").alias("lines"))
    assert sum(r.lines for r in counted.collect()) == lines.count()
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan and "Sort [" not in plan


def test_documents_of_mixed_types_and_bad_ones(spark):
    texts = ['{"z": {"k": 1}, "a": [1, "x"], "m": null, "b": "q", "c": 2.5, "d": true}', "{}", "[1]", "3", "", None, '{"a": 1', '{"a": 1, "a": 2}', '{"ü": {"deep": {"er": [1]}}}']
    rows, bad = keyed_variant(spark.createDataFrame([(t, 1) for t in texts], "value string, key int"))
    got = sorted((r.position, r.key, r.kind, r.text) for r in rows.select("*", F.to_json("value").alias("text")).collect())
    assert got == [(0, "z", "OBJECT", '{"k":1}'), (0, "ü", "OBJECT", '{"deep":{"er":[1]}}'), (1, "a", "ARRAY", '[1,"x"]'), (2, "m", "VOID", "null"), (3, "b", "STRING", '"q"'), (4, "c", "DECIMAL", "2.5"), (5, "d", "BOOLEAN", "true")]
    assert Counter(r.value for r in bad.collect()) == Counter(["[1]", "3", "", None, '{"a": 1', '{"a": 1, "a": 2}'])
    assert rows.select(F.expr("try_variant_get(value, '$.deep.er[0]', 'int')").alias("x")).where("x = 1").count() == 1


def test_functions_in_sql_text(spark):
    sql.register(spark)
    rows = [(p, q) for p in (None, "", "nan", "34.9", "35", "50", "69.99", "90", "x") for q in (None, "nan", "39.9", "40")]
    df = spark.createDataFrame(rows, "p string, q string")
    df.createOrReplaceTempView("labels_in")
    got = spark.sql("SELECT p, q, novelty_label(tolerant_number(p), tolerant_number(q)) AS label FROM labels_in").collect()
    want = df.select("p", "q", candidates.novelty_label(num("p"), num("q")).alias("label")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len({r.label for r in got}) >= 6
    r = spark.sql("SELECT safe_name('a b/ü.c-d_e') AS s, reverse_complement_of('ACGTNryk') AS r").first()
    assert r.s == "a_b_.c-d_e" and r.r == "mryNACGT"
    assert "PythonUDF" not in spark.sql("SELECT novelty_label(1.0, 2.0)")._jdf.queryExecution().optimizedPlan().toString()


def test_first_distinct_in_sql_text(spark):
    sql.register(spark)
    rnd = random.Random(1)
    rows = [(rnd.choice("abc"), rnd.choice([None, 1, 2, 3, 4, 5, 6]), k) for k in range(200)]
    spark.createDataFrame(rows, "k string, v int, at int").repartition(5).createOrReplaceTempView("hits_in")
    got = sorted(map(tuple, spark.sql("SELECT key, rank, value FROM first_distinct(TABLE(hits_in) PARTITION BY (k) ORDER BY (at), 'k', 'v', 4)").collect()))
    want = sorted((k, i + 1, v) for k in "abc" for i, v in enumerate(list(dict.fromkeys(v for g, v, _ in rows if g == k and v is not None))[:4]))
    assert got == want
    for bad in ("'k', 'nothing', 4", "'k', 'v', -1"):
        with pytest.raises(Exception, match="first_distinct"):
            spark.sql(f"SELECT * FROM first_distinct(TABLE(hits_in) PARTITION BY (k) ORDER BY (at), {bad})").collect()


def test_first_distinct_gets_few_rows_and_columns(spark):
    sql.register(spark)
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", "c", None]), rnd.choice([None, *range(30)]), k, "x" * 50) for k in range(900)]
    spark.createDataFrame(rows, "k string, v int, at int, more string").repartition(5).createOrReplaceTempView("hits_in")
    few = sql.first_rows("hits_in", "k", "v", "at", 4)
    asked = "SELECT key, rank, value FROM first_distinct(TABLE({}) PARTITION BY (k) ORDER BY (at), 'k', 'v', 4)"
    got = [spark.sql(asked.format(x)) for x in ("hits_in", few)]
    assert spark.sql(few).count() == 16
    plain = [(k, i + 1, v) for k in ("a", "b", "c", None) for i, v in enumerate(list(dict.fromkeys(v for g, v, _, _ in rows if g == k and v is not None))[:4])]
    for df in got:
        assert sorted(map(tuple, df.collect()), key=str) == sorted(plain, key=str)
    # What the rows are not asked by does not go to Python.
    sent = next(x for x in got[0]._jdf.queryExecution().executedPlan().toString().splitlines() if "named_struct" in x)
    assert "more" not in sent and "at#" not in sent


def test_coverage_against_a_plain_count(spark):
    rnd = random.Random(9)
    lengths = {"a": 50, "b": 7, "c": 10, "none": 5}
    reads = [(rnd.choice(["a", "b", "c", "other"]), s := rnd.randint(-5, 45), s + rnd.randint(0, 20), rnd.choice([0, 0, 16, 4, 256, 1024, 512, 2048]), rnd.randint(0, 60)) for _ in range(120)]
    refs = spark.createDataFrame(list(lengths.items()), "reference string, length long")
    got = {r.reference: r for r in depth.reference_coverage(spark.createDataFrame(reads, "reference string, start long, end long, flag int, mapq int"), refs, width=8).collect()}
    for name, size in lengths.items():
        held = [r for r in reads if r[0] == name and not r[3] & (4 | 256 | 512 | 1024)]
        at = Counter(p for r in held for p in range(r[1], r[2]) if 0 <= p < size)
        x = got[name]
        assert (x.reads, x.covered_bases) == (len(held), len(at))
        assert (x.coverage, x.mean_depth) == pytest.approx((100 * len(at) / size, sum(at.values()) / size), abs=1e-6)
        assert x.mean_mapq == pytest.approx(sum(r[4] for r in held) / len(held) if held else 0, abs=1e-6)
    assert set(got) == set(lengths)


def test_flag_summary_by_hand(spark):
    flags = [0, 0x1 | 0x2 | 0x40, 0x1 | 0x2 | 0x80, 0x1 | 0x8 | 0x40, 0x1 | 0x4 | 0x80, 0x100, 0x800, 0x400, 0x200, 0x4]
    got = {r.category: (r.passed, r.failed) for r in report.flag_summary(spark.createDataFrame([(f,) for f in flags], "flag int")).collect()}
    assert got == {
        "total": (9, 1), "primary": (7, 1), "secondary": (1, 0), "supplementary": (1, 0), "duplicates": (1, 0), "primary duplicates": (1, 0), "mapped": (7, 1), "primary mapped": (5, 1), "paired": (4, 0), "read1": (2, 0), "read2": (2, 0),
        "properly paired": (2, 0), "with itself and mate mapped": (2, 0), "singletons": (1, 0),
    }
