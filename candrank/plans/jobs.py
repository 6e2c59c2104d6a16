"""Further queries: replication and docking jobs, homologs, reports, and files that are written to the shared folder and read again."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.functions import sql
from candrank.operators import decision, dedup, depth, docking, groups, homologs, manifest, replication, report, select
from candrank.plans.queries import LINE_ORDER, _candidates, pose_rmsd, t, verdict_table
from candrank.sources import catalogue, constants, metadata, readers, writers
from candrank.sources.shared import shared_dir, stored
from candrank.streaming import landing


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def _members(spark: SparkSession, d: str) -> DataFrame:
    """lineage=order, run=supplier, members=its lines by number; motifs from flags."""
    lines = t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min_by(F.struct("l_suppkey", "l_returnflag", "l_linestatus", "l_discount"), F.struct("l_suppkey", *LINE_ORDER)).alias("x"))
    name = F.concat_ws("_", "l_orderkey", "l_linenumber")
    return lines.select(
        F.col("l_orderkey").alias("lineage"), F.col("x.l_suppkey").cast("string").alias("accession"), F.col("l_linenumber").alias("ordinal"), F.concat(F.lit("q"), name).alias("query"), F.concat(F.lit("n"), name).alias("nt_contig"),
        F.when(F.col("x.l_returnflag") == "R", "ACB").when(F.col("x.l_returnflag") == "A", "CAB").otherwise("ABC").alias("pssm_ABC"), F.lit("a").alias("motif_A"), F.col("x.l_linestatus").alias("motif_B"), F.lit("c").alias("motif_C"),
        (F.col("x.l_discount") * 1000).alias("pident"),
    )


def replication_summary(spark: SparkSession, d: str) -> DataFrame:
    """The replication job: sequences of one letter by the supplier's parity, so that members of one parity are strong pairs and others have nothing in common."""
    members = stored(_members(spark, d), "members")
    letter = lambda even, odd: F.repeat(F.when(F.col("accession").cast("long") % 2 == 0, even).otherwise(odd), 30)
    aa = members.select(F.col("query").alias("id"), letter(F.lit("m"), F.lit("k")).alias("seq"))
    nt = members.select(F.col("nt_contig").alias("id"), letter(F.lit("a"), F.lit("c")).alias("seq"))
    out = replication.replication(members, aa, nt)[1]
    return out.select("lineage", "member_count", "distinct_runs", "runs", "all_complete", "min_value", "max_value", "strong_cross_run_pairs", "cross_run_replication")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct(*LINE_ORDER).alias("ordinal")
    return t(spark, d, "lineitem").select(F.when(F.col("l_linenumber") < 7, F.concat(F.lit("p "), F.col("l_partkey"))).otherwise("").alias("qseqid"), F.col("l_suppkey").cast("string").alias("saccver"), order)


def homolog_lists(spark: SparkSession, d: str) -> DataFrame:
    """queries=parts, hits=lines in order of scan, those without a query do not count; the first four distinct suppliers of each."""
    queries = t(spark, d, "part").select(F.concat(F.lit("p "), F.col("p_partkey")).alias("id"))
    return homologs.homolog_lists(_hits(spark, d), queries, 4).select("id", F.array_join("subjects", ";").alias("subjects"))


def homolog_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Each part with its first four homologs as records, and how many each bundle has."""
    queries = t(spark, d, "part").select(F.concat(F.lit("p "), F.col("p_partkey")).alias("id"), F.col("p_name").alias("seq"))
    ranked = dedup.top_n_distinct(_hits(spark, d).where("qseqid <> ''"), "qseqid", "saccver", 4, "ordinal")
    sequences = t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("header"), F.lit("M").alias("seq"))
    made = homologs.bundles(queries, ranked, sequences)
    n = homologs.retrieved(made)
    text = F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "kind", "header"))), ",")
    return made.groupBy("query").agg(text.alias("records")).join(n, "query")


def headline(spark: SparkSession, d: str) -> DataFrame:
    """completed accessions=brands, candidates=parts with their first hit."""
    return report.headline(t(spark, d, "part").select("p_brand").distinct(), _candidates(spark, d))


def ranked_report(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 candidates over all, as a report shows them."""
    rows = _candidates(spark, d).select("*", F.round("pident", 3).cast("decimal(9,3)").alias("identity"), F.round("palm_score", 3).cast("decimal(9,3)").alias("score"))
    return report.ranked_report(rows, 50, ["p_partkey", "subject", "identity", "score", "novelty_screen"], "p_partkey")


def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.flag_counts(t(spark, d, "events").select("event_type", (F.col("event_id") % 4096).alias("flag")), "event_type")


def low_rmsd_share(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(c, 4).alias(c)
    return docking.low_rmsd_share(pose_rmsd(spark, d), ["label"]).select("label", r("mean_median_rmsd"), r("low_rmsd_system_fraction"))


def pose_contacts(spark: SparkSession, d: str) -> DataFrame:
    """system=label; every fifth vector is a pose of one atom, the others are receptor atoms of two chains with residues by number."""
    xyz = [(F.col("embedding")[i].cast("double") * 20).alias(c) for i, c in enumerate("xyz")]
    points = t(spark, d, "embeddings").where(F.col("embedding").isNotNull()).select("vec_id", F.col("label").cast("string").alias("system"), *xyz)
    pose = [F.lit("l").alias("ligand_std"), "system", F.lit("blind").alias("grid_category"), F.lit("m").alias("run_mode"), F.col("vec_id").alias("seed")]
    ligand = points.where("vec_id % 5 = 0").select(*pose, F.lit(0).alias("atom_idx"), "x", "y", "z")
    receptor = points.where("vec_id % 5 <> 0").select("system", F.when(F.col("vec_id") % 2 == 0, "A").otherwise("B").alias("chain"), (F.col("vec_id") % 53).alias("residue"), "x", "y", "z")
    out = docking.contacts(ligand, receptor, ("A", "B"), docking.ContactRule(radius=2.5, near=3.0))
    return out.select("system", "seed", "contacts_1", "contacts_2", "contacts", F.round("distance_site", 6).alias("distance_site"), "dual_chain", "strong_cleft", "near_site")


def published(spark: SparkSession, d: str) -> DataFrame:
    """The publication table over the verdicts, with descriptors by display name."""
    rows = verdict_table(spark, d).select(
        F.concat(F.col("ligand_std"), F.lit("_x")).alias("ligand_std"), "priority_order", "n", "mean_LE", F.lit(-5.804).alias("mean_score"), F.lit(0.255).alias("sd_score"), (F.col("dual_percent") / 100).alias("dual_chain_fraction"),
        F.lit(0.9).alias("strong_cleft_fraction"), F.lit(0.375).alias("low_rmsd_system_fraction"), F.lit(3.44).alias("mean_contacts_1"), F.lit(2.26).alias("mean_contacts_2"), F.lit(8.16).alias("mean_distance_site"),
    )
    names = t(spark, d, "lineitem").select(F.concat(F.col("l_returnflag"), F.lit(" x")).alias("Compound"), F.lower("l_returnflag").alias("herb")).where("herb <> 'r'").distinct()
    out = docking.publish(rows, names)
    return out.select(*(F.col(f"`{c}`").alias(c.lower().replace(" ", "_").replace("-", "_").replace("%", "percent")) for c in out.columns))


def table_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as tab-separated files in one folder for each status, read again by name in one scan; missing cells come back missing."""
    to = _folder(spark)
    orders = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("customer"), "o_orderpriority", (F.col("o_totalprice") > 1000).alias("complete"), "o_orderstatus")
    for status in ("O", "F", "P"):
        writers.write_table(orders.where(F.col("o_orderstatus") == status).drop("o_orderstatus"), f"{to}/{status}", skip_empty=True)
    back = readers.read_table(spark, to, "o_orderkey bigint, customer bigint, o_orderpriority string, complete boolean", name="*.csv", must_exist=True)
    return back.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count("customer").alias("with_customer"), F.sum("customer").alias("customers"), F.count_if("complete").alias("complete"))


def depth_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines of (part, size, line number) as a depth table with a fourth field, written and read again."""
    to = _folder(spark)
    line = F.concat_ws("\t", F.concat(F.lit("p"), F.col("l_partkey")), F.col("l_quantity").cast("int"), "l_linenumber", F.lit("more"))
    t(spark, d, "lineitem").select(line).write.text(to)
    rows = readers.read_depth(spark, to).select("reference", "pos", "depth")
    references = t(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("reference"), F.col("p_size").cast("long").alias("length"))
    return depth.depth_summary(rows, references).select("reference", "reference_length", "breadth_1x", "mean_depth", "zero_bases")


def hit_table_2(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as headerless lines of the second layout, some of ten fields, of which eight are enough."""
    fields = ["l_partkey", "l_suppkey", F.col("l_discount") * 1000, F.lit(5), F.lit(6), F.lit(7), F.when(F.col("l_linenumber") == 1, "").otherwise(F.col("l_quantity").cast("string")), F.lit("1e-9"), "l_linenumber", F.lit("9606")]
    line = F.concat_ws("\t", *[F.col(f).cast("string") if isinstance(f, str) else f for f in fields])
    line = F.when(F.col("l_orderkey") % 4 == 0, F.substring_index(line, "\t", 6)).when(F.col("l_orderkey") % 4 == 1, line).otherwise(F.concat(line, F.lit("\tname\ttitle")))
    rows = readers.hits(t(spark, d, "lineitem").select(F.struct(*LINE_ORDER).alias("ordinal"), line.alias("value")), readers.HITS_2, 8)
    return rows.groupBy("qseqid").agg(F.count("*").alias("hits"), F.count("qcovs").alias("with_qcov"), F.count("stitle").alias("with_title"), F.min("evalue").alias("evalue"), F.round(F.sum("bitscore"), 2).alias("bitscore"))


def run_files(spark: SparkSession, d: str) -> DataFrame:
    """Runs with packed lists of files in a table of few columns, read as run metadata (the first row of a run) and expanded to downloads."""
    to = _folder(spark)
    o = t(spark, d, "orders")
    urls = F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws(";", F.concat(F.lit("h/"), F.col("o_orderkey")), F.lit(""), F.concat(F.lit("http://h/"), F.col("o_custkey")))).otherwise(F.concat(F.lit("h/"), F.col("o_orderkey")))
    rows = o.select(F.concat(F.lit("R"), F.col("o_orderkey")).alias("run_accession"), urls.alias("fastq_ftp"), F.when(F.col("o_orderkey") % 2 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("read_count"))
    writers.write_table(rows, to)
    runs = metadata.run_metadata(spark, to)
    return metadata.fastq_plan(runs, "read_count").select("run_accession", "url", "md5", "bytes", "read_count")


def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Accession summaries as JSON documents, one for each part of the write, read again."""
    to = _folder(spark)
    writers.write_json(_candidates(spark, d).groupBy(F.col("p_brand").alias("accession")).agg(F.count("*").alias("candidates"), F.count_if("high_interest_screen").alias("high_interest")), to)
    return spark.read.schema("accession string, candidates bigint, high_interest bigint").json(to)


def motif_table(spark: SparkSession, d: str) -> DataFrame:
    """Members with complete motifs by order."""
    whole = replication.motif_complete()
    return _members(spark, d).groupBy("pssm_ABC").agg(F.count("*").alias("members"), F.count_if(whole).alias("complete"))


def usable_runs(spark: SparkSession, d: str) -> DataFrame:
    """The run filter alone over a catalogue that is read by names from a file with more columns in another order."""
    to = _folder(spark)
    o = t(spark, d, "orders")
    rows = o.select(
        F.lit("more").alias("spots"), F.floor(F.col("o_totalprice") / 50).cast("string").alias("size_MB"), F.concat(F.when(F.col("o_orderstatus") == "P", "XRR").otherwise(" ERR"), F.col("o_orderkey")).alias("Run"),
        F.when(F.col("o_orderstatus") == "O", "rna-seq").otherwise("WGS").alias("LibraryStrategy"), F.when(F.col("o_orderkey") % 3 == 0, "TRANSCRIPTOMIC").otherwise("GENOMIC").alias("LibrarySource"),
    )
    rows.write.option("header", True).csv(to)
    c = readers.read_catalogue(spark, [to])
    runs = c.select(F.col("Run").alias("run"), F.col("LibraryStrategy").alias("library_strategy"), F.col("LibrarySource").alias("library_source"), F.col("size_MB").alias("size_mb"), "BioProject")
    return runs.where(select.usable(select.RunRules())).select(F.trim("run").alias("run"), F.col("size_mb").cast("double").alias("size_mb"), F.coalesce("BioProject", F.lit("unknown")).alias("bioproject"))


def near_identical(spark: SparkSession, d: str) -> DataFrame:
    """The known-sequence rule alone: hits of lines by their identity and coverage."""
    hit = F.struct((F.col("l_discount") * 1000).alias("pident"), (F.col("l_quantity") * 2).alias("qcovs")).alias("hit")
    rule = decision.DecisionRule(protein=(90.0, 80.0))
    rows = t(spark, d, "lineitem").select("l_returnflag", hit).select("l_returnflag", decision.near_identical("hit", rule.protein).alias("known"))
    return rows.groupBy("l_returnflag").agg(F.count_if("known").alias("known"), F.count("*").alias("n"))


def bundle_files(spark: SparkSession, d: str) -> DataFrame:
    """The bundles of homolog_bundles as one file for each part, read again in the order of the files."""
    to = _folder(spark)
    queries = t(spark, d, "part").select(F.concat(F.lit("p "), F.col("p_partkey")).alias("id"), F.upper("p_name").alias("seq"))
    ranked = dedup.top_n_distinct(_hits(spark, d).where("qseqid <> ''"), "qseqid", "saccver", 4, "ordinal")
    sequences = t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("header"), F.lit("M").alias("seq"))
    files = homologs.write_bundles(homologs.bundles(queries, ranked, sequences), to)
    return homologs.read_bundles(spark, to, files).select("query", F.col("place").cast("long").alias("place"), "header")


def _dated_runs(spark: SparkSession, d: str) -> DataFrame:
    """orders as a run catalogue: organism=status, label=priority, strategy and source from keys."""
    o, text = t(spark, d, "orders"), lambda c: F.col(c).cast("string")
    return o.select(
        F.col("o_orderpriority").alias("label"), F.concat(F.lit("SRR"), F.col("o_orderkey")).alias("run"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("release_date"), F.col("o_orderstatus").alias("organism"),
        F.when(F.col("o_orderkey") % 3 == 0, "RNA-Seq").otherwise("WGS").alias("library_strategy"), F.when(F.col("o_orderkey") % 2 == 0, "TRANSCRIPTOMIC").alias("library_source"), text("o_totalprice").alias("size_mb"), text("o_custkey").alias("bioproject"),
    )


def catalogue_pushed(spark: SparkSession, d: str) -> DataFrame:
    """The search of a catalogue in files: organisms and dates are pushed into the source, strategy or source stays with Spark; the 50 newest of each label."""
    to = _folder(spark)
    catalogue.write_catalogue(_dated_runs(spark, d), to)
    runs = catalogue.read_catalogue_folder(spark, to).where((F.col("library_strategy") == "RNA-Seq") | (F.col("library_source") == "TRANSCRIPTOMIC"))
    return select.catalogue_filter(runs, ["O", "F"], "1995-01-15", "1996-11-30", 50).select("label", "run", "release_date", "organism", "library_strategy", "library_source", "bioproject")


def incremental_rank(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that land as files in two drops, each taken by the stream once; the first 50 over all that has landed."""
    base = _folder(spark)
    rows = _candidates(spark, d)
    for drop in (0, 1):
        rows.where(F.col("p_partkey") % 2 == drop).write.mode("append").parquet(f"{base}/drops")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/drops")
        landing.land(stream, f"{base}/landed", f"{base}/checkpoint").awaitTermination()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    found = landing.landed(spark, f"{base}/landed", schema).select("*", F.round("pident", 3).cast("decimal(9,3)").alias("identity"), F.round("palm_score", 3).cast("decimal(9,3)").alias("score"))
    return report.ranked_report(found, 50, ["p_partkey", "subject", "identity", "score", "novelty_screen"], "p_partkey")


def file_digests(spark: SparkSession, d: str) -> DataFrame:
    """One file for each supplier, with its digests, and the digest of all of them one after another."""
    to = _folder(spark)
    rows = t(spark, d, "supplier").select("s_suppkey", F.concat_ws("|", "s_name", F.col("s_acctbal").cast("decimal(15,2)")).alias("value"))
    written = writers.write_files(rows, "s_suppkey", to)
    key = F.regexp_extract("path", "s_suppkey=([0-9]+)/", 1).cast("long").alias("supplier")
    files = manifest.file_manifest(spark, to, written=written).select(key, "bytes", "sha256", "md5")
    listed = manifest.listed(spark, to) if written is None else manifest.named(written, to)
    parts = listed.select(key, "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("supplier", "path"))), lambda x: x["path"]).alias("paths")).select(F.lit(-1).cast("long").alias("supplier"), "paths")
    return files.unionByName(manifest.digests(parts, "supplier", "paths"))


def running_groups(spark: SparkSession, d: str) -> DataFrame:
    """Orders as header lines with two kinds of mark, their lines below them, in text files; each line finds its header again."""
    to = _folder(spark)
    head = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("line"), F.concat(F.when(F.col("o_orderkey") % 2 == 0, "> ").otherwise(";"), F.col("o_orderkey")).alias("value"))
    body = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.concat_ws("|", "l_linenumber", F.col("l_quantity").cast("int")).alias("value"))
    known = body.join(head.select("k"), "k", "left_semi")
    head.unionByName(known).repartition("k").sortWithinPartitions("k", "line", "value").select("value").write.text(to)
    lines = groups.running_groups(readers.with_ordinal(spark.read.text(to)), F.col("value").rlike("^[>;]"))
    quantity = F.substring_index("value", "|", -1)
    made = lines.groupBy("head", "header").agg(F.count_if(~F.col("is_header")).alias("lines"), F.coalesce(F.sum(F.when(~F.col("is_header"), quantity.try_cast("bigint"))), F.lit(0)).alias("quantity"))
    return made.select("header", "lines", "quantity")


def keyed_variant(spark: SparkSession, d: str) -> DataFrame:
    """A document of three values for each event, of mixed types, some that do not parse: how many values of each key and type, and bad documents."""
    e = F.col("event_id")
    mixed = F.when(e % 5 == 0, "1.5").when(e % 5 == 1, '"x"').when(e % 5 == 2, "null").when(e % 5 == 3, "[1, 2]").otherwise("7")
    whole = F.concat(F.lit('{"z": '), "props", F.lit(', "n": '), mixed, F.lit(', "id": '), e, F.lit("}"))
    documents = t(spark, d, "events").where(F.col("props").isNotNull()).select(F.when(e % 7 == 0, F.lit('{"z": ')).when(e % 11 == 0, F.lit("[1]")).otherwise(whole).alias("value"))
    rows, bad = readers.keyed_variant(documents)
    number = F.when(F.col("key") == "id", F.expr("try_variant_get(value, '$', 'bigint')"))
    counted = rows.groupBy("key", "kind", "position").agg(F.count("*").alias("n"), F.coalesce(F.sum(number), F.lit(0)).alias("ids"))
    return counted.unionByName(bad.agg(F.lit("bad").alias("key"), F.lit("").alias("kind"), F.lit(-1).alias("position"), F.count("*").alias("n"), F.lit(0).cast("long").alias("ids")))


def sql_novelty(spark: SparkSession, d: str) -> DataFrame:
    """The labels of candidates and how many have each, asked in SQL text, with numbers that come as text."""
    sql.register(spark)
    _candidates(spark, d).select(F.col("pident").cast("string").alias("pident"), F.col("qcov").cast("string").alias("qcov")).createOrReplaceTempView("candrank_candidates")
    return spark.sql("SELECT novelty_label(tolerant_number(pident), tolerant_number(qcov)) AS novelty_screen, count(*) AS n FROM candrank_candidates GROUP BY 1")


def sql_homologs(spark: SparkSession, d: str) -> DataFrame:
    """The first four distinct suppliers of each part, asked in SQL text by a table function over partitions."""
    sql.register(spark)
    _hits(spark, d).where("qseqid <> ''").createOrReplaceTempView("candrank_hits")
    rows = sql.first_rows("candrank_hits", "qseqid", "saccver", "ordinal", 4)
    return spark.sql(f"SELECT safe_name(key) AS name, rank, value FROM first_distinct(TABLE({rows}) PARTITION BY (qseqid) ORDER BY (ordinal), 'qseqid', 'saccver', 4)")


def reference_coverage(spark: SparkSession, d: str) -> DataFrame:
    """reference=part of three times its size, alignments=lines with flags and qualities from keys."""
    start = F.floor("l_quantity") - 3
    rows = t(spark, d, "lineitem").select(F.col("l_partkey").alias("reference"), start.alias("start"), (start + F.col("l_linenumber") * 3).alias("end"), (F.col("l_orderkey") % 4096).alias("flag"), (F.col("l_suppkey") % 61).alias("mapq"))
    return depth.reference_coverage(rows, t(spark, d, "part").select(F.col("p_partkey").alias("reference"), (F.col("p_size") * 3).cast("long").alias("length")))


def published_scan(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as a published table: names with dots and brackets, lines that end in two characters, some cells that do not parse."""
    to = _folder(spark)
    key = F.col("s_suppkey")
    rows = t(spark, d, "supplier").select(
        F.lit("more").alias("Extra"), F.concat("s_name", F.lit(", é")).alias("Compound"), F.when(key % 5 == 0, "n/a").otherwise((key % 40).cast("string")).alias("n poses"),
        F.round(F.col("s_acctbal") / 1000, 2).alias("Mean score (kcal/mol)"), (key % 3).alias("Lipinski viol."), F.when(key % 7 > 0, "none").alias("PAINS flag"), (F.round(F.col("s_acctbal")) / 4).alias("Mean dist res50 (Å)"),
    )
    rows.write.option("header", True).option("lineSep", "\r\n").csv(to)
    got = readers.read_published(spark, to, "triage")
    names = {"Compound": "compound", "n poses": "n_poses", "Mean score (kcal/mol)": "mean_score", "Lipinski viol.": "violations", "PAINS flag": "flag", "Mean dist res50 (Å)": "distance", "Source herb": "herb"}
    return got.select(*(F.col(f"`{c}`").alias(name) for c, name in names.items()))


def target_runs(spark: SparkSession, d: str) -> DataFrame:
    """The built-in targets against a catalogue of orders: usable runs of each organism, and the runs that are always kept if none was found."""
    organisms = constants.targets(spark)
    listed = F.array(*(F.lit(o) for o in sorted({o for _, x in constants.TARGETS[:6] for o in x})))
    o = t(spark, d, "orders").select(F.element_at(listed, (F.col("o_orderkey") % F.size(listed) + 1).cast("int")).alias("organism"), "o_orderkey")
    found = organisms.join(o, "organism", "left").groupBy("label", "organism").agg(F.count("o_orderkey").alias("runs"))
    kept = constants.fallback_runs(spark).select("label", "organism", F.lit(0).cast("long").alias("runs"))
    return select.append_missing(found.where("runs > 0"), kept.dropDuplicates(["label"]), "label")


def output_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of each nation in one file; the manifest of these files as it was written, and a row that its own digest is that of its text."""
    to, listed = _folder(spark), _folder(spark)
    rows = t(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.concat_ws("|", "s_suppkey", "s_name").alias("value"))
    rows.repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey").select("s_nationkey", "value").write.partitionBy("s_nationkey").text(to)
    outer = report.output_manifest(spark, to, listed).select("sha256", F.element_at(F.split("path", "/"), -1).alias("name")).where("name LIKE 'part-%'")
    text = spark.read.text(listed, wholetext=True).select(F.sha2("value", 256).alias("sha256"))
    files = spark.read.schema("path string, bytes bigint, sha256 string").json(listed)
    made = files.select(F.regexp_extract("path", "s_nationkey=([0-9]+)/", 1).cast("long").alias("nation"), "bytes", "sha256")
    return made.unionByName(outer.join(text, "sha256").agg(F.lit(-1).cast("long").alias("nation"), F.count("*").alias("bytes"), F.lit("same").alias("sha256")))


def empty_outputs(spark: SparkSession, d: str) -> DataFrame:
    """A table of each order status with none of its rows or all: how many rows come back, with the header alone or without a file where there are none."""
    orders, made = t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), []
    for status in ("O", "F", "none"):
        for skip in (False, True):
            to = _folder(spark)
            writers.write_table(orders.where(F.col("o_orderstatus") == status), to, one_file=True, skip_empty=skip)
            back = readers.read_table(spark, to, "o_orderkey bigint, o_orderstatus string")
            made.append(back.agg(F.lit(status).alias("status"), F.lit(skip).alias("skip_empty"), F.count("*").alias("rows"), F.coalesce(F.sum("o_orderkey"), F.lit(0)).alias("keys")))
    return functools.reduce(DataFrame.unionByName, made)


def crowded_contacts(spark: SparkSession, d: str) -> DataFrame:
    """system=label parity; half of all vectors lie in one small spot: how many others each has around it, in cells of at most 64."""
    near = F.when(F.col("vec_id") % 2 == 0, 0.4).otherwise(20.0)
    xyz = [(F.col("embedding")[i].cast("double") * near).alias(c) for i, c in enumerate("xyz")]
    points = t(spark, d, "embeddings").where(F.col("embedding").isNotNull()).select((F.col("label") % 2).alias("system"), "vec_id", *xyz)
    met = docking.neighbourhoods(points, points, ["system"], 0.75, "vec_id", "vec_id", crowded=64)
    return met.select("system", "vec_id", "n", F.col("total").alias("ids"), F.round("farthest", 6).alias("farthest"))


def flag_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.flag_summary(t(spark, d, "events").select("event_type", (F.col("event_id") % 4096).alias("flag")), "event_type")


QUERIES = {
    f.__name__: f
    for f in (
        replication_summary, homolog_lists, homolog_bundles, headline, ranked_report, flag_counts, low_rmsd_share, pose_contacts, published, table_roundtrip,
        depth_scan, hit_table_2, run_files, json_roundtrip, motif_table, usable_runs, near_identical,
        bundle_files, catalogue_pushed, incremental_rank, file_digests, running_groups, keyed_variant, sql_novelty, sql_homologs, reference_coverage, flag_summary, crowded_contacts,
        published_scan, target_runs, output_manifest, empty_outputs,
    )
}
