"""Operators on small frames with the edge rows of their inputs."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from candrank.functions import exprs as X
from candrank.operators import candidates as C
from candrank.operators import decision, dedup, depth, docking, manifest, replication, select, sequences
from candrank.sources import readers, writers
from candrank.streaming.filter import filter_fasta_stream


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def test_tolerant_numbers(spark):
    df = spark.createDataFrame([("1.5",), (" 2 ",), ("x",), ("",), (None,), ("nan",)], "v string").select(X.num("v", 7).alias("n"))
    got = [r.n for r in df.collect()]
    assert got[:5] == [1.5, 2.0, 7.0, 7.0, 7.0] and got[5] != got[5]


def test_scalars(spark):
    df = spark.createDataFrame([("ACGTN", "a b/c", "r1_frame=+3")], "s string, n string, q string")
    r = df.select(X.reverse_complement(F.col("s")).alias("s"), X.safe_name(F.col("n")).alias("n"), X.contig_key(F.col("q")).alias("q")).first()
    assert (r.s, r.n, r.q) == ("NACGT", "a_b_c", "r1")


def test_fasta_edges(spark, tmp_path):
    (tmp_path / "a.fa").write_text("junk\n>x one\r\nAC\r\n\n gt \n  >y\n>x two\nGG")
    (tmp_path / "b.fa").write_text("junk\nmore\n>z\nAAAA\n")
    df = readers.read_fasta(spark, str(tmp_path))
    assert rows(df, "id", "header", "seq") == [("x", "x one", "ACgt"), ("x", "x two", "GG"), ("y", "y", ""), ("z", "z", "AAAA")]
    last = dedup.last_by(df, ["id"], "ordinal")
    assert {r.id: r.seq for r in last.collect()}["x"] == "GG"


def test_fasta_writer_wraps_and_reads_back(spark, tmp_path):
    df = spark.createDataFrame([("a b", "A" * 170), ("c", "")], "header string, seq string")
    writers.write_fasta(df, str(tmp_path / "o"))
    assert rows(readers.read_fasta(spark, str(tmp_path / "o")), "id", "seq") == [("a", "A" * 170), ("c", "")]


def test_annotations_edges(spark):
    lines = ["q1\tscore=\tpalm_score=80\tbare\tgene=a=b\tgene=c", "\tscore=1", "q2"]
    df = readers.annotations(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "ordinal int, value string"))
    got = {r.id: r.attrs for r in df.collect()}
    assert got == {"q1": {"score": "", "palm_score": "80", "gene": "c"}, "q2": {}}


def test_hits_skip_short_rows(spark):
    line = lambda n, p="9": "\t".join(["q", "s", p, *["1"] * (n - 3)])
    df = readers.hits(spark.createDataFrame([(0, line(11)), (1, line(13, "x")), (2, line(12))], "ordinal int, value string"), readers.HITS_1)
    assert [(r.ordinal, r.pident) for r in df.orderBy("ordinal").collect()] == [(1, None), (2, 9.0)]


def test_absent_table_is_empty(spark, tmp_path):
    assert readers.read_table(spark, str(tmp_path / "none"), "a string").isEmpty()
    with pytest.raises(Exception):
        readers.read_table(spark, str(tmp_path / "none"), "a string", must_exist=True)


def test_tables_of_a_name_in_one_scan(spark, tmp_path):
    for d in ("x", "y"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "t.tsv").write_text(f"a\tb\n{d}\t1\n")
        (tmp_path / d / "other.tsv").write_text("a\tb\nno\t1\n")
    assert rows(readers.read_table(spark, str(tmp_path), "a string, b int", name="t.tsv")) == [("x", 1), ("y", 1)]


def test_novelty_and_interest(spark):
    cases = [(None, None, "no_PALMdb_hit"), (10.0, 39.9, "weak_partial_hit"), (34.9, 40.0, "very_divergent_lt35pct"), (35.0, None, "divergent_35_50pct"), (50.0, 90.0, "moderate_50_70pct"), (70.0, 90.0, "close_70_90pct"), (90.0, 90.0, "PALMdb_sOTU_level_ge90pct"), (float("nan"), 90.0, "PALMdb_sOTU_level_ge90pct")]
    df = spark.createDataFrame(cases, "p double, q double, want string").withColumn("got", C.novelty_label(F.col("p"), F.col("q")))
    assert all(r.want == r.got for r in df.collect())
    hi = spark.createDataFrame([(75.0, 49.9, 40.0, 90, True), (float("nan"), None, None, 90, False), (None, None, None, 90, True), (None, 50.0, None, 90, False), (None, None, None, 89, False)], "s double, p double, q double, n int, want boolean")
    assert all(r.want == r.got for r in hi.withColumn("got", C.high_interest(F.col("s"), F.col("p"), F.col("q"), F.col("n"))).collect())


def test_candidate_table(spark):
    aa = spark.createDataFrame([("c1_frame=1", 100), ("c2", 10)], "query string, aa_length int")
    ann = spark.createDataFrame([("c1_frame=1", {"score": "", "rdrp_score": "80", "pssm_score": ""})], "id string, attrs map<string,string>")
    hit = spark.createDataFrame([("c1_frame=1", "s", 30.0, 80.0, 1.0, 1e-9, 50.0)], "query string, subject string, pident double, qcov double, scov double, evalue double, bitscore double")
    nt = spark.createDataFrame([("c1", "ACGT")], "id string, seq string")
    got = {r.query: r for r in C.candidate_table(aa, ann, hit, nt).collect()}
    assert got["c1_frame=1"].nt_length == 4 and got["c1_frame=1"].palm_score == 80.0 and got["c1_frame=1"].high_interest_screen and got["c1_frame=1"].pssm_score is None
    assert got["c2"].novelty_screen == "no_PALMdb_hit" and got["c2"].nt_length == 0


def test_union_strictness(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, 3)], "x int, y int")
    assert C.union_tables([a, b]).count() == 2
    with pytest.raises(ValueError):
        C.union_tables([a, b], strict=True)


CATALOGUE = "label string, run string, library_strategy string, library_source string, size_mb string, bioproject string, release_date string, ordinal int"


@pytest.mark.parametrize("preference,want", [("fewest", ["SRR9"]), ("most", ["SRR1", "SRR2", "SRR3"])])
def test_run_selection(spark, preference, want):
    data = [("l", f"SRR{i}", "rna-seq", "x", str(i), "big", "2024", i) for i in (3, 2, 1, 4)] + [
        ("l", "SRR9", "x", "transcriptomic", "4500", "small", "2023", 9), ("l", "SRR8", "OTHER", "x", "4501", "s2", "2025", 8), ("l", "SRR7", "OTHER", "x", "", "s3", "2025", 7), ("l", "XRR", "OTHER", "x", "1", "s4", "2025", 6), ("l", "SRR5", None, None, "1", "s5", "2026", 5)
    ]
    got = select.select_runs(spark.createDataFrame(data, CATALOGUE), select.RunRules(project_preference=preference))
    assert [r.run for r in got.orderBy("k").collect()] == want


def test_diversity_cap_and_fallback(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("a", 4)], "label string, i int")
    assert [r.i for r in dedup.diversity_cap(df, "label", 3, "i").collect()] == [1, 3, 2]
    more = select.append_missing(df, spark.createDataFrame([("z", 4), ("z", 5)], "label string, i int"), "i")
    assert rows(more) == [("a", 1), ("a", 2), ("a", 4), ("b", 3), ("z", 5)]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_first_hit_does_not_depend_on_partitions(spark, parts):
    df = spark.range(200).select((F.col("id") % 7).alias("k"), (F.col("id") * 37 % 200).alias("o")).repartition(parts)
    got = {r.k: r.v for r in dedup.first_by(df.withColumn("v", F.col("o")), ["k"], "o").collect()}
    assert got == {k: min(i * 37 % 200 for i in range(200) if i % 7 == k) for k in range(7)}


def plain_align(a, b, s):
    m = {}
    best = 0.0
    neg = float("-inf")
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                m[i, j] = (0.0, neg, neg)
                continue
            up = max(m[i - 1, j][1] + s.extend, m[i - 1, j][0] + s.open)
            left = max(m[i, j - 1][2] + s.extend, m[i, j - 1][0] + s.open)
            h = max(0.0, m[i - 1, j - 1][0] + (s.match if a[i - 1] == b[j - 1] else s.mismatch), up, left)
            m[i, j] = (h, up, left)
            best = max(best, h)
    return best


def test_alignment_scores():
    rnd = random.Random(5)
    for _ in range(60):
        a, b = ("".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 40))) for _ in range(2))
        b = a[: rnd.randint(0, 20)] + b + a[rnd.randint(0, 20) :] if rnd.random() < 0.6 else b
        for s in (replication.PROTEIN, replication.NUCLEOTIDE):
            score, matches, aligned = replication.align(a, b, s)
            assert score == pytest.approx(plain_align(a, b, s)) and matches <= aligned <= min(len(a), len(b))
    assert replication.local_stats("AACCGGTTAC", "GTAACCGGTT", replication.NUCLEOTIDE)[5] == "-"
    assert replication.local_stats("MKV*X", "MKV*X", replication.PROTEIN)[1:3] == (1.0, 5)


def test_replication(spark):
    seq = "ACGTTGCAAGGCTTACG" * 4
    members = spark.createDataFrame(
        [("L", f"q{i}", f"R{r}", f"n{i}", i, "ABC", "a", "b", "c", 60.0 + i) for i, r in enumerate((1, 1, 2))] + [("M", "q9", "R1", "n9", 9, "CAB", "a", "", "c", 50.0)],
        "lineage string, query string, accession string, nt_contig string, ordinal int, pssm_ABC string, motif_A string, motif_B string, motif_C string, pident double",
    )
    aa = spark.createDataFrame([(f"q{i}", "mkvlaa" * 10) for i in (0, 1, 2, 9)], "id string, seq string")
    nt = spark.createDataFrame([(f"n{i}", seq) for i in (0, 1, 2, 9)], "id string, seq string")
    pairs, summary = replication.replication(members, aa, nt)
    assert rows(pairs, "i_1", "i_2") == [(1, 3), (2, 3)]
    got = {r.lineage: r for r in summary.collect()}
    assert got["L"].cross_run_replication == "strong" and got["L"].runs == "R1;R2" and got["L"].strong_cross_run_pairs == 2
    assert got["M"].cross_run_replication == "not_established" and not got["M"].all_complete
    with pytest.raises(ValueError):
        replication.replication(members, aa.where("id <> 'q9'"), nt)


@pytest.mark.parametrize("length", [1, 6, 16, 37])
def test_depth_summary_equals_dense(spark, length):
    rnd = random.Random(length)
    dense = [rnd.choice([0, 0, 1, 3, 5, 12]) for _ in range(length)]
    data = [("r", p + 1, d) for p, d in enumerate(dense) if d] + [("r", length + 1, 9), ("unknown", 1, 9)]
    refs = spark.createDataFrame([("r", length), ("empty", 4)], "reference string, length long")
    got = {r.reference: r for r in depth.depth_summary(spark.createDataFrame(data, "reference string, pos long, depth long"), refs).collect()}
    r, s = got["r"], sorted(dense)
    assert r.median_depth == statistics.median(dense) and r.zero_bases == dense.count(0)
    assert r.depth_p10 == s[round((length - 1) * 0.1)] and r.depth_p90 == s[round((length - 1) * 0.9)]
    assert r.mean_depth == pytest.approx(statistics.fmean(dense), abs=1e-6) and r.breadth_5x == pytest.approx(sum(d >= 5 for d in dense) / length, abs=1e-6)
    mean = statistics.fmean(dense)
    assert r.depth_cv == pytest.approx(statistics.pstdev(dense) / mean if mean and length > 1 else 0, abs=1e-6)
    assert (got["empty"].zero_bases, got["empty"].median_depth, got["empty"].depth_cv) == (4, 0.0, 0.0)


def test_sweep(spark):
    df = spark.createDataFrame([("r", 0, 5), ("r", 3, 8), ("r", 8, 9), ("r", 2, 2)], "reference string, start int, end int")
    assert rows(depth.depth_from_intervals(df), "start", "end", "depth") == [(0, 3, 1), (3, 5, 2), (5, 9, 1)]


def test_decisions(spark):
    hit = lambda acc, p=50.0, q=50.0, e=1e-9, b=100.0, title="cell": (acc, p, q, e, b, "sp", title)
    cases = [
        (True, "strong", 2, hit("v", 90.0, 80.0), None, None, "currently_known_or_near_identical_sequence"),
        (True, "strong", 2, hit("v"), None, hit("n", 95.0, 80.0), "currently_known_or_near_identical_sequence"),
        (True, "strong", 2, hit("v"), hit("a", b=120.1), None, "rejected_or_ambiguous_cellular_match"),
        (True, "strong", 2, hit("v"), hit("a", b=120.0), None, "supported_unreported_RdRP_lineage_candidate"),
        (True, "strong", 2, hit("v"), hit("v", b=500.0), None, "supported_unreported_RdRP_lineage_candidate"),
        (True, "strong", 2, hit("v"), hit("a", b=500.0, title="A Virus"), None, "supported_unreported_RdRP_lineage_candidate"),
        (True, "strong", 2, None, hit("a"), None, "rejected_or_ambiguous_cellular_match"),
        (True, "strong", 1, hit("v"), None, None, "assembly_replicated_RdRP_candidate_raw_support_incomplete"),
        (True, "strong", 2, hit("v", e=1e-4), None, None, "insufficient_validation"),
        (False, "strong", 2, hit("v"), None, None, "insufficient_validation"),
    ]
    h = "struct<saccver:string,pident:double,qcovs:double,evalue:double,bitscore:double,sscinames:string,stitle:string>"
    df = spark.createDataFrame(cases, f"motif_complete boolean, replication string, supported_run_count int, viral {h}, `any` {h}, nt {h}, want string")
    assert all(r.want == r.decision for r in decision.decide(df).collect())


def test_distance_join_and_contacts(spark):
    rnd = random.Random(1)
    pts = [(i, *(rnd.uniform(-6, 6) for _ in "xyz")) for i in range(60)]
    df = spark.createDataFrame([("s", *p) for p in pts], "system string, i int, x double, y double, z double")
    got = rows(docking.within(df, df, ["system"], 4.0).select("a.i", F.col("b.i").alias("j")))
    assert got == sorted((p[0], q[0]) for p in pts for q in pts if sum((a - b) ** 2 for a, b in zip(p[1:], q[1:])) ** 0.5 <= 4.0)
    pose = ("lig", "s", "blind", "m", 1)
    lig = spark.createDataFrame([(*pose, 0, 0.0, 0.0, 0.0)], "ligand_std string, system string, grid_category string, run_mode string, seed int, atom_idx int, x double, y double, z double")
    rec = [("s", "A", 1, 4.0), ("s", "A", 2, 1.0), ("s", "B", 1, 2.0), ("s", "B", 2, 3.0), ("s", "B", 3, 4.1), ("s", "B", 50, 8.0)]
    receptor = lambda r: spark.createDataFrame([(s, c, n, 0, x, 0.0, 0.0) for s, c, n, x in r], "system string, chain string, residue int, atom_idx int, x double, y double, z double")
    r = docking.contacts(lig, receptor(rec), ("A", "B")).first()
    assert (r.contacts_1, r.contacts_2, r.contacts, r.dual_chain, r.strong_cleft, r.near_site) == (2, 2, 4, True, False, True)
    assert docking.contacts(lig, receptor([*rec, ("s", "B", 4, 0.5)]), ("A", "B")).first().strong_cleft


def test_pose_rmsd(spark):
    atoms = spark.createDataFrame([("g", p, a, float(p * (p - 1)), 0.0) for p in (1, 2, 3) for a in (0, 1)] + [("h", 1, 0, 0.0, 0.0)], "g string, pose int, atom int, x double, y double")
    got = {r.g: r for r in docking.pose_rmsd(atoms, ["g"], "pose", "atom", ["x", "y"]).collect()}
    assert (got["g"].mean_pairwise_rmsd, got["g"].median_pairwise_rmsd, got["g"].max_pairwise_rmsd, got["g"].n_poses) == (4.0, 4.0, 6.0, 3)
    assert got["h"].mean_pairwise_rmsd is None and not got["h"].pose_cluster_low_rmsd


def test_roll_up_equals_weighted_means(spark):
    df = spark.createDataFrame([("a", "x", 1.0, True), ("a", "x", 3.0, False), ("a", "y", 8.0, True)], "l string, g string, s double, f boolean")
    got = {r.g: r for r in docking.pose_summary(df, "l", "g", "s", ["f"], []).collect()}
    assert got[None].mean_score == pytest.approx(4.0) and got[None].sd_score == pytest.approx(statistics.stdev([1, 3, 8])) and got[None].f_fraction == pytest.approx(2 / 3)


def test_publication_table(spark):
    decision_ = spark.createDataFrame([("A_b", 3, -5.804, 0.255, 0.975, 0.9, 0.375, 3.44, 2.26, 8.16, 24.0, 1, "Main")], "ligand_std string, n int, mean_score double, sd_score double, dual_chain_fraction double, strong_cleft_fraction double, low_rmsd_system_fraction double, mean_contacts_1 double, mean_contacts_2 double, mean_distance_site double, mean_heavy_atoms double, priority_order int, role_text string")
    roles = decision_.select("ligand_std", "role_text", "priority_order", "mean_heavy_atoms")
    done = docking.final_decision(decision_.drop("role_text", "priority_order", "mean_heavy_atoms"), roles)
    assert "variable/manual review" in done.first().stage16_preliminary_verdict
    r = docking.publish(done, spark.createDataFrame([("A b", "herb")], "Compound string, herb string")).first()
    assert (r["Compound"], r["herb"], r["Mean score"], r["Pose repro %"], r["Mean contacts 1"]) == ("A b", "herb", -5.8, 38, 3.4)


def test_manifest(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    (tmp_path / "b").write_text("y")
    actual = manifest.file_manifest(spark, str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    good = {r.path: r.sha256 for r in actual.collect()}
    expected = spark.createDataFrame([("a", good["a"]), ("b", "0"), ("c", "1")], "path string, sha256 string")
    assert rows(manifest.verify(expected, actual, "path", "sha256")) == [("a", "ok"), ("b", "mismatch"), ("c", "missing")]


def test_download_plan(spark):
    df = spark.createDataFrame([("r", "h/1;http://h/2;", "m1", "5;6;7"), ("s", "", "", "")], "run string, u string, m string, b string")
    assert rows(readers.download_plan(df, F.col("u"), F.col("m"), F.col("b"), "run")) == [("r", "http://h/2", "", "6"), ("r", "https://h/1", "m1", "5")]


def test_sequence_filter_edges(spark):
    cases = [("A" * 600, True), ("A" * 599, False), ("acgu n" * 200, True), ("A" * 570 + "X" * 30, True), ("A" * 569 + "X" * 31, False), ("", False), (None, False), ("A" * 100_000, True), ("A" * 100_001, False)]
    df = spark.createDataFrame(cases, "s string, want boolean").withColumn("c", sequences.clean(F.col("s"))).withColumn("got", sequences.passes(F.col("c")))
    assert all(r.want == r.got for r in df.collect())
    again = df.where("got").withColumn("again", sequences.passes(sequences.clean(F.col("c"))))
    assert again.where("NOT again").isEmpty()
    s = sequences.counters(df, "c", F.col("got")).first()
    assert tuple(s) == (9, 4, 600 + 1000 + 600 + 100_000, 600, 100_000)


def test_stream_restarts_without_repeats(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">x\n" + "ACGT" * 200 + "\n>short\nAC\n")
    filter_fasta_stream(spark, source, out, check).awaitTermination()
    (tmp_path / "in" / "b.fa").write_text(">y\n" + "acgu" * 200 + "\n")
    filter_fasta_stream(spark, source, out, check).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["x", "y"]


def test_metadata_wide_or_narrow(spark, tmp_path):
    from candrank.sources.metadata import fastq_plan, run_metadata

    (tmp_path / "m.tsv").write_text("run_accession\tfastq_ftp\tread_count\nR1\th/a;h/b\t12\nR1\tother\tx\n")
    df = run_metadata(spark, str(tmp_path / "m.tsv"))
    assert rows(df, "run_accession", "read_count", "fastq_md5") == [("R1", 12, None)]
    assert rows(fastq_plan(df), "url") == [("https://h/a",), ("https://h/b",)]
    (tmp_path / "e.tsv").write_text("run_accession\n")
    with pytest.raises(ValueError):
        run_metadata(spark, str(tmp_path / "e.tsv"))


def test_files_of_runs_meet_nothing_again(spark, tmp_path):
    """Rows of a run in several splits: the first counts, its columns come with its files, and firsts are taken after rows are dealt."""
    from candrank.sources.metadata import fastq_plan, run_metadata

    lines = [f"R{k % 40}\th/{k};h/x{k}\t{k}" for k in range(400)]
    (tmp_path / "m.tsv").write_text("\n".join(["run_accession\tfastq_ftp\tread_count", *lines]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    try:
        made = fastq_plan(run_metadata(spark, str(tmp_path / "m.tsv")), "read_count")
        assert rows(made, "run_accession", "url", "read_count") == sorted((f"R{k}", f"https://h/{x}{k}", k) for k in range(40) for x in ("", "x"))
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert "Join" not in plan and plan.index("REPARTITION_BY_COL") > plan.index("partial_min_by")


def test_homologs(spark):
    from candrank.operators.homologs import bundles, homolog_lists, retrieved

    hits = spark.createDataFrame([("q", "b", 1), ("q", "b", 2), ("q", "a", 3), ("q", "c", 4), ("", "x", 0)], "qseqid string, saccver string, ordinal int")
    queries = spark.createDataFrame([("q", "MM"), ("r 1", "KK")], "id string, seq string")
    assert {r.id: r.subjects for r in homolog_lists(hits, queries, 2).collect()} == {"q": ["b", "a"], "r 1": []}
    made = bundles(queries, dedup.top_n_distinct(hits.where("qseqid <> ''"), "qseqid", "saccver", 2, "ordinal"), spark.createDataFrame([("b", "b x", "LL")], "id string, header string, seq string"))
    assert rows(made, "query", "header") == [("q", "b x"), ("q", "q|CANDIDATE"), ("r_1", "r 1|CANDIDATE")]
    assert rows(retrieved(made)) == [("q", 1), ("r_1", 0)]


def test_reports_and_constants(spark, tmp_path):
    from candrank.operators.report import flag_counts, headline, output_manifest, ranked_report
    from candrank.sources import constants

    df = spark.createDataFrame([("a", True, 30.0, 80.0, 100), ("b", True, None, None, 90), ("c", False, 1.0, 2.0, 3)], "q string, high_interest_screen boolean, pident double, palm_score double, aa_length int")
    assert [(r["rank"], r.q, r.pident) for r in ranked_report(df, 2, ["q", "pident"], "q").orderBy("rank").collect()] == [(1, "b", "NA"), (2, "a", "30.0")]
    assert tuple(headline(df, df).first()) == (3, 3, 2)
    f = flag_counts(spark.createDataFrame([("r", 3), ("r", 2048)], "run string, flag int"), "run").first()
    assert (f.total, f.proper, f.supplementary, f.unmapped) == (2, 1, 1, 0)
    writers.write_table(df, str(tmp_path / "t"), one_file=True)
    assert output_manifest(spark, str(tmp_path / "t"), str(tmp_path / "m")).count() >= 1
    assert constants.targets(spark).select("label").distinct().count() == 8 and constants.fallback_runs(spark).count() == 3


def test_json_documents_skip_broken_ones(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"accession": "A",\n "n": {"x": 1}}')
    (tmp_path / "b.json").write_text('{"accession": ')
    assert rows(readers.json_documents(spark, str(tmp_path), "accession string, n map<string,int>"), "accession") == [("A",)]
    keyed = readers.keyed_json(spark.createDataFrame([('{"L2": {"m": ["a"]}, "L1": {"m": []}}',)], "value string"), "struct<m:array<string>>", "lineage")
    assert [(r.lineage, r.m) for r in keyed.orderBy("position").collect()] == [("L2", ["a"]), ("L1", [])]


def plain_path(a, b, s):
    """(score, matches, aligned) of the path with the same choices among equal scores, cell by cell: diagonal, gap in b, gap in a, short gaps first."""
    neg = float("-inf")
    h = {(i, j): (0.0, 0, 0) for i in range(len(a) + 1) for j in range(len(b) + 1)}
    up, left = ({k: (neg, 0, 0) for k in h} for _ in range(2))
    best = (0.0, 0, 0)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            move = lambda x, by: (x[0] + by, x[1], x[2])
            up[i, j] = max(move(h[i - 1, j], s.open), move(up[i - 1, j], s.extend), key=lambda x: x[0])
            left[i, j] = max(move(h[i, j - 1], s.open), move(left[i, j - 1], s.extend), key=lambda x: x[0])
            d, same = h[i - 1, j - 1], a[i - 1] == b[j - 1]
            diagonal = (d[0] + (s.match if same else s.mismatch), d[1] + same, d[2] + 1)
            here = max(diagonal, up[i, j], left[i, j], key=lambda x: x[0])
            h[i, j] = here if here[0] > 0 else (0.0, 0, 0)
            if h[i, j][0] > best[0]:
                best = h[i, j]
    return best


def test_alignment_paths():
    rnd = random.Random(11)
    for k in range(80):
        a = "".join(rnd.choice("ACGT" if k % 2 else "AC") for _ in range(rnd.randint(0, 50)))
        b = "".join(c for c in a if rnd.random() < 0.8) + "".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 15)))
        for s in (replication.PROTEIN, replication.NUCLEOTIDE):
            assert replication.align(a, b, s) == pytest.approx(plain_path(a, b, s)), (a, b)


def test_alignment_of_long_texts_takes_little_memory():
    import tracemalloc

    rnd = random.Random(3)
    a = "".join(rnd.choice("ACGT") for _ in range(3_000))
    b = a[:1_000] + "".join(rnd.choice("ACGT") for _ in range(12_000)) + a[1_000:]
    tracemalloc.start()
    score, matches, aligned = replication.align(a, b, replication.NUCLEOTIDE)
    assert score >= 2 * 2_000 and matches >= 2_000 and aligned >= matches and tracemalloc.get_traced_memory()[1] < 10e6
    tracemalloc.stop()


def test_pairs_of_conversations(spark, duck):
    """All pairs of turns of one beginning and different conversations, each with the plain path's statistics."""
    from candrank.plans.registry import QUERIES

    def made(texts):
        found = {}
        for i, (c1, t1, x) in enumerate(texts):
            for c2, t2, y in texts[i + 1 :]:
                if c1 != c2 and x[:6].lower() == y[:6].lower():
                    score, matches, aligned = plain_path(x, y, replication.PROTEIN)
                    found[c1, t1, c2, t2] = (score, round(100 * matches / aligned, 3), aligned, round(100 * aligned / len(x), 3), round(100 * aligned / len(y), 3))
        return found

    import os
    import tempfile

    rows = [(i // 2, i % 2, f"{'the same beginning' if i % 3 else 'another one'} {'abc' * (i % 5)} and {'x' * (i % 4)}") for i in range(14)] + [(90, 0, None)]
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(os.path.join(folder, "conversations.parquet"))
    out = QUERIES["pair_score_strong"](spark, f"file://{folder}").collect()
    got = {(r.conv_id_1, r.turn_1, r.conv_id_2, r.turn_2): (r.aa_score, r.aa_identity, r.aa_aligned, r.aa_coverage_1, r.aa_coverage_2) for r in out}
    want = made(sorted(r for r in rows if r[2]))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-3) for k in want)
    assert all(r.strong == (r.aa_identity >= 90 and min(r.aa_coverage_1, r.aa_coverage_2) >= 50) for r in out) and {r.strong for r in out} == {True, False}


def test_kmer_prefilter(spark):
    df = spark.createDataFrame([("l", "a", "abcdefghijklmnop"), ("l", "b", "xxabcdefghijklmnopyy"), ("l", "c", "qrstuvwxyz0123456"), ("m", "d", "abcdefghijklmnop"), ("l", "e", "")], "lineage string, id string, seq string")
    assert rows(replication.kmer_pairs(df, "lineage", "id", "seq")) == [("l", "a", "b")]


def test_depth_of_a_repeated_position_is_the_last(spark):
    refs = spark.createDataFrame([("r", 2)], "reference string, length long")
    data = spark.createDataFrame([("r", 1, 7, 0), ("r", 1, 5, 1), ("r", 2, 3, 2)], "reference string, pos long, depth long, ordinal int")
    r = depth.depth_summary(data, refs, order=("ordinal",)).first()
    assert (r.breadth_1x, r.mean_depth, r.median_depth, r.zero_bases) == (1.0, 4.0, 4.0, 0)
    assert depth.depth_summary(data, refs).first().mean_depth == 5.0


@pytest.mark.parametrize("width", [1, 3, 1 << 20])
def test_sweep_in_ranges(spark, width):
    rnd = random.Random(2)
    spans = [(r, a, a + rnd.randint(1, 20)) for r in "rs" for a in (rnd.randint(0, 60) for _ in range(30))]
    got = depth.depth_from_intervals(spark.createDataFrame(spans, "reference string, start int, end int"), width)
    dense = {(r, p): sum(q == r and a <= p < b for q, a, b in spans) for r in "rs" for p in range(90)}
    assert {(r.reference, p): r.depth for r in got.collect() for p in range(r.start, r.end)} == {k: v for k, v in dense.items() if v}
    flagged = spark.createDataFrame([("r", 0, 2, 0), ("r", 0, 2, 0x400), ("r", 1, 3, 0x800)], "reference string, start int, end int, flag int")
    assert rows(depth.alignment_depth(flagged), "start", "end", "depth") == [(0, 1, 1), (1, 2, 2), (2, 3, 1)]
    counts = depth.reference_counts(flagged.withColumn("flag", F.col("flag") + F.when(F.col("start") == 1, 4).otherwise(0)), spark.createDataFrame([("r", 9), ("e", 4)], "reference string, length int"))
    assert rows(counts) == [("e", 4, 0, 0), ("r", 9, 2, 1)]


def test_final_table(spark):
    h = "struct<saccver:string,pident:double,qcovs:double,evalue:double,bitscore:double,sscinames:string,stitle:string>"
    case = ("L", True, "missing", None, 0, None, None, 61.5, ("v", 90.0, 80.0, 1e-9, 1.0, None, "t"), None, None)
    df = spark.createDataFrame([case], f"lineage string, motif_complete boolean, replication string, distinct_runs int, supported_run_count int, supported_runs string, minimum_palmdb_identity double, pident double, viral {h}, `any` {h}, nt {h}")
    out = decision.decision_table(df)
    assert len(out.columns) == 22
    assert tuple(out.first()) == ("L", "currently_known_or_near_identical_sequence", "missing", "0", "0", "", "61.500", "v", "90.000", "80.000", "", "t", "", "", "", "", "", "", "", "", "true", "false")
    from candrank.operators.report import lineage_audit

    assert tuple(lineage_audit(out).first())[2:] == ("0", "0", "v", "90.000/80.000", "NA/NA")


def test_catalogue_depth_and_published_tables(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes(b'Run,spots,BioProject,size_MB,ScientificName\nSRR1,9,P1,12,"Panax, \xff sp."\nSRR2,,,x,\n')
    got = readers.read_catalogue(spark, [str(tmp_path / "c.csv")])
    assert rows(got, "Run", "BioProject", "size_MB", "ScientificName", "bases") == [("SRR1", "P1", "12", "Panax, \ufffd sp.", None), ("SRR2", None, "x", None, None)]
    (tmp_path / "empty.csv").write_text("")
    assert readers.read_catalogue(spark, []).isEmpty() and readers.read_catalogue(spark, [str(tmp_path / "empty.csv")]).isEmpty()
    (tmp_path / "d.tsv").write_text("r\t1\t5\textra\nr\t1\t7\nshort\t1\n")
    assert [tuple(r)[1:] for r in readers.read_depth(spark, str(tmp_path / "d.tsv")).orderBy("ordinal").collect()] == [("r", 1, 5), ("r", 1, 7)]
    (tmp_path / "t.csv").write_text("Compound,Mean score (kcal/mol),Mean dist res50 (Å),n poses\r\nCoptisine,-6.49,8.2,64\r\n")
    r = readers.read_published(spark, str(tmp_path / "t.csv"), "triage").first()
    assert (r["Compound"], r["Mean score (kcal/mol)"], r["Mean dist res50 (Å)"], r["n poses"], r["MW"]) == ("Coptisine", -6.49, 8.2, 64, None)


def test_a_bad_schema_is_no_absent_table(spark, tmp_path):
    with pytest.raises(Exception):
        readers.read_table(spark, str(tmp_path / "none"), "a nosuchtype")


def test_json_documents_and_empty_tables(spark, tmp_path):
    import json

    df = spark.createDataFrame([(2, "b", None), (1, 'a"', 1.5)], "i int, s string, x double")
    array = writers.json_array(df, "i")
    want = [{"i": 1, "s": 'a"', "x": 1.5}, {"i": 2, "s": "b", "x": None}]
    assert json.loads(array.first().value) == want
    document = writers.json_document({"include": array, "queries": writers.json_array(df.where("i > 9"), "i")}, {"generated": 'now "x"'})
    assert json.loads(document.first().value) == {"generated": 'now "x"', "include": want, "queries": []}
    writers.write_document(document, str(tmp_path / "doc"))
    assert len(list((tmp_path / "doc").glob("part-*"))) == 1
    writers.write_table(df.limit(0), str(tmp_path / "none"), one_file=True)
    assert [f.read_text() for f in (tmp_path / "none").glob("part-*")] == ["i\ts\tx\n"]
    writers.write_table(df.limit(0), str(tmp_path / "skipped"), skip_empty=True)
    assert not (tmp_path / "skipped").exists()


def test_digest_of_parts_in_order(spark, tmp_path):
    import hashlib

    for name, data in (("b", b"one\n"), ("a", b"\xfftwo")):
        (tmp_path / name).write_bytes(data)
    r = manifest.parts_digest(spark, [str(tmp_path / "b"), str(tmp_path / "a")]).first()
    assert tuple(r) == (2, 8, hashlib.sha256(b"one\n\xfftwo").hexdigest())


def test_poses_that_name_different_atoms(spark):
    atoms = spark.createDataFrame([("g", 1, 0, 0.0), ("g", 1, 1, 1.0), ("g", 2, 1, 4.0), ("g", 2, 2, 9.0), ("g", 3, 7, 1.0)], "g string, pose int, atom int, x double")
    r = docking.pose_rmsd(atoms, ["g"], "pose", "atom", ["x"]).first()
    assert (r.n_poses, r.mean_pairwise_rmsd, r.max_pairwise_rmsd) == (3, 3.0, 3.0)


def test_runs_in_their_own_accession(spark):
    aa = spark.createDataFrame([("R1", "q", 100), ("R2", "q", 100)], "accession string, query string, aa_length int")
    ann = spark.createDataFrame([("R1", "q", {"score": "80"})], "accession string, id string, attrs map<string,string>")
    hit = spark.createDataFrame([("R2", "q", "s", 30.0, 80.0, 1.0, 1e-9, 50.0)], "accession string, query string, subject string, pident double, qcov double, scov double, evalue double, bitscore double")
    nt = spark.createDataFrame([("R1", "q", "ACGT")], "accession string, id string, seq string")
    out = C.candidate_table(aa, ann, hit, nt)
    assert len(out.columns) == 25
    assert rows(out, "accession", "palm_score", "best_palmdb_sotu", "nt_length") == [("R1", 80.0, None, 4), ("R2", None, "s", 0)]


def test_no_shared_folder_on_a_cluster_raises(monkeypatch):
    from types import SimpleNamespace

    from candrank.sources.shared import shared_dir

    conf = {"spark.checkpoint.dir": None}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: conf[k], set=conf.__setitem__), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="app"))
    with pytest.raises(ValueError):
        shared_dir(session)
    session.sparkContext.master = "local[2]"
    assert shared_dir(session).startswith("file://") and conf["spark.checkpoint.dir"]
