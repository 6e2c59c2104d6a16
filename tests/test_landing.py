"""Catalogue files behind pushed filters, batches that land once, bundles in order, digests in chunks."""

import glob
import hashlib
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from candrank.operators import homologs, manifest
from candrank.sources.catalogue import FIELDS, read_catalogue_folder, write_catalogue
from candrank.streaming import landing


def runs_of(spark, n=400):
    rnd = random.Random(8)
    dates = [f"20{y}-{m:02d}-{d:02d}" for y in (23, 24, 25) for m in (1, 6, 12) for d in (1, 15, 28)] + [None, "", "2024"]
    rows = [(rnd.choice("ab"), f"SRR{k}", rnd.choice(dates), rnd.choice(["Homo sapiens", "Mus, musculus", "", None]), rnd.choice(["RNA-Seq", "WGS", None]), rnd.choice(["TRANSCRIPTOMIC", None]), str(k), rnd.choice(['a "quoted", one', "two\nlines", "é"])) for k in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in FIELDS))


def rows(df):
    return sorted(map(str, df.select(*FIELDS).collect()))


def test_filters_are_pushed_and_give_the_same_rows(spark, tmp_path):
    runs = runs_of(spark)
    write_catalogue(runs, f"file://{tmp_path}/c")
    read = read_catalogue_folder(spark, f"file://{tmp_path}/c")
    # A text writer cannot tell a folder's empty name from a missing one: both come back as missing.
    runs = runs.withColumn("organism", F.when(F.col("organism") != "", F.col("organism")))
    date, organism, either = F.col("release_date"), F.col("organism"), (F.col("library_strategy") == "RNA-Seq") | (F.col("library_source") == "TRANSCRIPTOMIC")
    conditions = [
        F.lit(True), organism == "Homo sapiens", organism.isin("Mus, musculus", "none"), date.between("2024-01-15", "2025-06-01"), date > "2024-06", date < "2024-06", date <= "2024-06-15", date >= "2024-12-28", date == "2024-06-15", date == "2024",
        date == "", date.isNull(), organism.isNull(), either & date.between("2024-01-01", "2025-12-31") & organism.isin("Homo sapiens", "Mus, musculus"), F.col("library_strategy").isin("WGS", "OTHER") & (date > "2025"), (date > "2024-06") & (date < "2024-06"), ~organism.isin("Homo sapiens"),
    ]
    for c in conditions:
        assert rows(read.where(c)) == rows(runs.where(c)), c
    assert read.where(date > "2024-06").select("run").count() == runs.where(date > "2024-06").count()


def test_files_outside_the_window_are_not_opened(spark, tmp_path):
    write_catalogue(runs_of(spark), f"file://{tmp_path}/c")
    for path in glob.glob(f"{tmp_path}/c/*/*/*.csv"):
        if "release_month=2024-06/organism=Homo sapiens" not in path.replace("%20", " "):
            os.remove(path)
            os.mkdir(path)  # whoever opens it fails
            os.mkdir(f"{path}/release_month=2024-06")
    found = read_catalogue_folder(spark, f"file://{tmp_path}/c").where(F.col("release_date").between("2024-06-01", "2024-06-30") & (F.col("organism") == "Homo sapiens") & F.col("bioproject").contains("o"))
    want = runs_of(spark).where(F.col("release_date").between("2024-06-01", "2024-06-30") & (F.col("organism") == "Homo sapiens") & F.col("bioproject").contains("o"))
    assert rows(found) == rows(want) and want.count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan run_catalogue" in plan and "Contains(bioproject" in plan
    assert "2024-06" not in plan and "Homo sapiens" not in plan  # taken by the source: not left to Spark's own filter


def test_a_window_without_a_file_and_an_empty_catalogue(spark, tmp_path):
    write_catalogue(runs_of(spark), f"file://{tmp_path}/c")
    read = read_catalogue_folder(spark, f"file://{tmp_path}/c")
    assert not read.where(F.col("release_date") > "2030").collect()
    write_catalogue(runs_of(spark).limit(0), f"file://{tmp_path}/e")
    assert not read_catalogue_folder(spark, f"file://{tmp_path}/e").collect()


SCHEMA = "id long, score double"


def drop(spark, tmp_path, ids):
    spark.createDataFrame([(i, i / 2) for i in ids], SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")


def test_batches_that_break_off_or_are_replayed_land_once(spark, tmp_path, monkeypatch):
    to, checkpoint = f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"

    def take():
        stream = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in")
        landing.land(stream, to, checkpoint).awaitTermination()

    seen = lambda: sorted((r.id, r.score) for r in landing.landed(spark, to, SCHEMA).collect())
    want = lambda ids: [(i, i / 2) for i in ids]
    assert seen() == []
    drop(spark, tmp_path, [1, 2])
    take()
    assert seen() == want([1, 2])
    # The driver dies after the batch was written, before its line of the ledger.
    drop(spark, tmp_path, [3])
    real, calls = landing.keep_batch, itertools.count()

    def killed(batch, i, folder):
        if next(calls) == 0:
            batch.write.mode("overwrite").parquet(f"{folder}/batches/batch={i}")
            raise RuntimeError("killed")
        real(batch, i, folder)

    monkeypatch.setattr(landing, "keep_batch", killed)
    with pytest.raises(Exception, match="killed"):
        take()
    assert seen() == want([1, 2])
    take()
    assert seen() == want([1, 2, 3])
    # It dies after that line, before the stream's own checkpoint has noted the batch: the batch comes again.
    for name in os.listdir(f"{tmp_path}/checkpoint/commits"):
        if name.strip(".").split(".")[0] == "1":
            os.remove(f"{tmp_path}/checkpoint/commits/{name}")
    take()
    assert next(calls) > 2 and seen() == want([1, 2, 3])
    drop(spark, tmp_path, [4, 5])
    take()
    take()
    assert seen() == want([1, 2, 3, 4, 5])
    assert [r.landed for r in landing.ledger(spark, to).orderBy("batch").collect()] == [2, 1, 2]


def test_bundles_are_one_file_each_in_order(spark, tmp_path):
    rnd = random.Random(2)
    queries = spark.createDataFrame([(f"q {k}", "ACGT" * (k % 40)) for k in range(60)], "id string, seq string").repartition(7)
    ranks = [(f"q {k}", r + 1, f"s{s}") for k in range(0, 60, 2) for r, s in enumerate(rnd.sample(range(30), 12))]
    ranked = spark.createDataFrame(ranks, "qseqid string, rank int, saccver string").repartition(5)
    sequences = spark.createDataFrame([(f"s{s}", f"s{s} of a kind", "MK" * (60 - s)) for s in range(30)], "id string, header string, seq string")
    homologs.write_bundles(homologs.bundles(queries, ranked, sequences), f"file://{tmp_path}/b")
    files = {os.path.basename(d).split("=")[1]: glob.glob(f"{d}/*.txt") for d in glob.glob(f"{tmp_path}/b/query=*")}
    assert len(files) == 60 and all(len(f) == 1 for f in files.values())
    for k in range(60):
        heads = [line[1:].strip() for line in open(files[f"q_{k}"][0]) if line.startswith(">")]
        assert heads == [f"q {k}|CANDIDATE"] + [f"{s} of a kind" for q, _, s in ranks if q == f"q {k}"]
    back = homologs.read_bundles(spark, f"file://{tmp_path}/b").where("query = 'q_4'").orderBy("place").collect()
    assert [r.place for r in back] == list(range(13)) and back[0].seq == "ACGT" * 4 and [r.id for r in back[1:]] == [s for q, _, s in ranks if q == "q 4"]
    assert {r.query: r.retrieved for r in homologs.retrieved(homologs.bundles(queries, ranked, sequences)).collect()}["q_4"] == 12


def test_digests_of_very_large_files_take_little_memory(spark, tmp_path):
    import tracemalloc

    os.mkdir(tmp_path / "parts")
    for name, size in (("whole", 3 << 30), ("parts/p1", 1 << 28), ("parts/p2", (1 << 28) + 5), ("parts/p3", (1 << 29) - 5)):
        with open(tmp_path / name, "wb") as f:
            f.seek(size - 1)
            f.write(b"\0")
    whole, parts = hashlib.sha256(), hashlib.sha256()
    for k in range(3 << 10):
        whole.update(bytes(1 << 20))
        if k < 1 << 10:
            parts.update(bytes(1 << 20))
    paths = [f"{tmp_path}/parts/{p}" for p in ("p1", "p2", "p3")]
    tracemalloc.start()
    assert manifest.fold([f"file://{p}" for p in paths])[:2] == (1 << 30, parts.hexdigest())
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()
    r = manifest.file_manifest(spark, f"file://{tmp_path}", recursive=False).collect()
    assert [(os.path.basename(x.path), x.bytes, x.sha256) for x in r] == [("whole", 3 << 30, whole.hexdigest())]
    assert tuple(manifest.parts_digest(spark, paths).first()) == (3, 1 << 30, parts.hexdigest())


def test_files_of_values_are_written_by_many_tasks(spark, tmp_path):
    """Each value has one whole file, in order, and small tables do not make one task write or read them all."""
    from candrank.sources.writers import write_files

    rows = [(k % 40 if k % 41 else None, k, f"line {k:03}" if k % 7 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, place int, value string").repartition(3)
    write_files(df, "k", f"file://{tmp_path}/f", "place")
    found = {os.path.basename(d).split("=")[1]: os.listdir(d) for d in glob.glob(f"{tmp_path}/f/k=*")}
    assert len(found) == 41 and all(sorted(x) == ["part-00000.txt"] for x in found.values())
    for k in (0, 7, None):
        name = "__HIVE_DEFAULT_PARTITION__" if k is None else str(k)
        assert open(f"{tmp_path}/f/k={name}/part-00000.txt").read() == "".join(f"{v or ''}\n" for c, _, v in rows if c == k)
    write_files(df, "k", f"file://{tmp_path}/f", "place")  # again, as a task that runs twice does
    assert spark.read.text(f"file://{tmp_path}/f").count() == 400
    plan = manifest.file_manifest(spark, f"file://{tmp_path}/f")
    assert plan.count() == 41 and "REPARTITION_BY_NUM" in plan._jdf.queryExecution().executedPlan().toString()


def test_bundles_are_read_by_the_names_that_tasks_left(spark, tmp_path):
    """No folder is listed: a file that no task named is not read, and the plan holds no scan of the folder."""
    from candrank.sources import readers

    rows = [(f"q {k}", "candidate", 0, f"q {k}|CANDIDATE", "ACGT" * 50) for k in range(30)] + [(f"q {k}", "homolog", 1 + r, f"h{r} of {k}", "" if r == 2 else "MK" * r) for k in range(0, 30, 3) for r in range(5)]
    made = spark.createDataFrame(rows, "query string, kind string, place int, header string, seq string").repartition(5)
    files = homologs.write_bundles(made, f"file://{tmp_path}/b")
    assert sorted(r.file for r in files.collect()) == sorted(f"query=q {k}/part-00000.txt" for k in range(30))
    want = sorted(map(tuple, homologs.read_bundles(spark, f"file://{tmp_path}/b").collect()))
    os.mkdir(tmp_path / "b" / "query=other")
    (tmp_path / "b" / "query=other" / "part-00000.txt").write_text(">other\nA\n")
    back = homologs.read_bundles(spark, f"file://{tmp_path}/b", files)
    assert sorted(map(tuple, back.collect())) == want and len(want) == len(rows)
    assert f"{tmp_path}/b" not in "".join(back.inputFiles())
    (tmp_path / "long").mkdir()
    (tmp_path / "long" / "x").write_text("text before\n> a 1\n" + "ACGT\n" * 600_000 + ">b\nMK\n\n")
    named = spark.createDataFrame([("x",)], "file string")
    found = [(r.id, len(r.seq)) for r in readers.fasta(readers.file_records(named, f"file://{tmp_path}/long")).orderBy("ordinal").collect()]
    assert found == [("a", 2_400_000), ("b", 2)] == [(r.id, len(r.seq)) for r in readers.read_fasta(spark, f"file://{tmp_path}/long").orderBy("ordinal").collect()]
