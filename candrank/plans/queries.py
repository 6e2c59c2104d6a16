"""The operators over the driver's tables, read under an analogous meaning."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candrank.functions import exprs as X
from candrank.operators import candidates as C
from candrank.operators import decision as DC
from candrank.operators import dedup, depth, docking, manifest, replication, report, select, sequences
from candrank.sources import readers
from candrank.sources.shared import shared_dir
from candrank.sources.writers import fasta_text
from candrank.streaming.filter import filter_stream

#: lineitem keys repeat, so ties go over the whole row.
LINE_ORDER = ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _first_lines(spark: SparkSession, d: str, flag: str | None = None) -> DataFrame:
    lines = t(spark, d, "lineitem")
    lines = lines.where(F.col("l_returnflag") == flag) if flag else lines
    best = dedup.first_by(lines, ["l_partkey"], *LINE_ORDER)
    return best.select("l_partkey", F.col("l_suppkey").alias("subject"), (F.col("l_discount") * 1000).alias("pident"), (F.col("l_quantity") * 2).alias("qcov"), F.col("l_extendedprice").alias("bitscore"), "l_linestatus", "l_orderkey", "l_linenumber")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """query=part, hit=first lineitem, score=p_retailprice-900, length=p_size*5, accession=p_brand."""
    part = t(spark, d, "part").select("p_partkey", "p_brand", (F.col("p_retailprice") - 900).alias("palm_score"), (F.col("p_size") * 5).alias("aa_length"))
    hit = _first_lines(spark, d).select(F.col("l_partkey").alias("p_partkey"), "subject", "pident", "qcov")
    joined = part.join(hit, "p_partkey", "left")
    p, q = F.col("pident"), F.col("qcov")
    return joined.withColumn("novelty_screen", C.novelty_label(p, q)).withColumn("high_interest_screen", C.high_interest(F.col("palm_score"), p, q, F.col("aa_length")))


def candidate_rank(spark: SparkSession, d: str) -> DataFrame:
    ranked = C.rank_within(_candidates(spark, d), "p_partkey").limit(20)
    rank = F.row_number().over(Window.orderBy(F.desc("high_interest_screen"), F.asc_nulls_first("pident"), F.desc("aa_length"), "p_partkey"))
    r = lambda c: F.round(c, 6).alias(c)
    return ranked.withColumn("rank", rank).select("rank", "p_partkey", "subject", r("pident"), r("qcov"), r("palm_score"), "aa_length", "novelty_screen", "high_interest_screen")


def novelty_distribution(spark: SparkSession, d: str) -> DataFrame:
    return C.distribution(_candidates(spark, d), "novelty_screen")


def accession_summary(spark: SparkSession, d: str) -> DataFrame:
    all_ = t(spark, d, "part").select(F.col("p_brand").alias("accession")).distinct()
    made = C.accession_summary(_candidates(spark, d).withColumnRenamed("p_brand", "accession"), all_)
    text = F.array_join(F.transform(F.map_entries("novelty_counts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return made.select("accession", "candidates", "high_interest", text.alias("novelty_counts"))


def first_hit(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_by(t(spark, d, "lineitem"), ["l_partkey"], *LINE_ORDER).select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")


def last_wins(spark: SparkSession, d: str) -> DataFrame:
    out = dedup.last_by(t(spark, d, "lineitem"), ["l_partkey"], *LINE_ORDER)
    return out.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", F.col("first_ordinal.l_orderkey").alias("first_orderkey"))


def top_n_distinct(spark: SparkSession, d: str) -> DataFrame:
    return dedup.top_n_distinct(t(spark, d, "lineitem"), "l_partkey", "l_suppkey", 3, *LINE_ORDER)


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _texts(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    docs = t(spark, d, "documents").select("doc_id", sequences.clean(F.col("text")).alias("seq"))
    return docs, sequences.passes(F.col("seq"), 600, 100_000, LETTERS, 0.9)


def seq_filter(spark: SparkSession, d: str) -> DataFrame:
    docs, keep = _texts(spark, d)
    return docs.where(keep).select("doc_id", F.length("seq").cast("long").alias("length"))


def seq_filter_stats(spark: SparkSession, d: str) -> DataFrame:
    docs, keep = _texts(spark, d)
    return sequences.counters(docs, "seq", keep)


def fasta_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """documents as FASTA text, wrapped, read back by the record splitter."""
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    docs = t(spark, d, "documents").select("doc_id", fasta_text(F.concat(F.lit("doc"), F.col("doc_id"), F.lit(" lang="), F.col("lang")), letters).alias("value"))
    raw = docs.select(F.struct(F.lit("memory").alias("file_path"), F.col("doc_id").alias("file_block_start"), (F.col("doc_id") + 1).alias("n")).alias("ordinal"), "value", F.lit(True).alias("is_first"))
    return readers.fasta(raw).select("id", "header", F.length("seq").cast("long").alias("length"), F.md5("seq").alias("seq_md5"))


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    return o.select(
        F.col("o_orderpriority").alias("label"), F.concat(F.when(F.col("o_orderstatus") == "P", "XRR").otherwise("SRR"), F.col("o_orderkey")).alias("run"),
        F.when(F.col("o_orderstatus") == "O", "RNA-Seq").otherwise("WGS").alias("library_strategy"), F.when(F.col("o_orderkey") % 3 == 0, "transcriptomic").otherwise("GENOMIC").alias("library_source"),
        F.round(F.col("o_totalprice") / 100, 2).alias("size_mb"), F.concat(F.lit("P"), F.col("o_custkey")).alias("bioproject"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("release_date"),
        F.col("o_orderkey").alias("ordinal"), F.col("o_orderstatus").alias("organism"),
    )


def _selection(preference: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rules = select.RunRules(project_preference=preference)
        chosen = select.select_runs(_catalogue(spark, d), rules)
        return select.capped(chosen, select.RunRules(total_cap=8), "label", "k").select("label", "k", F.col("run").alias("accession"), "bioproject", "release_date", "size_mb", "reason")

    return query


def catalogue_filter(spark: SparkSession, d: str) -> DataFrame:
    out = select.catalogue_filter(_catalogue(spark, d), ["O", "F"], "1995-01-01", "1996-12-31")
    return out.select("label", "run", "release_date", "organism")


def fallback_append(spark: SparkSession, d: str) -> DataFrame:
    """Customers with orders, then those without."""
    with_ = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    every = t(spark, d, "customer").select("c_custkey", F.lit(0).cast("long").alias("n"))
    return select.append_missing(with_, every, "c_custkey")


def multi_table_union(spark: SparkSession, d: str) -> DataFrame:
    """Parts of lineitem by flag, one without a column, united and ranked over all."""
    lines = t(spark, d, "lineitem").select("l_returnflag", *[c for c in LINE_ORDER if c != "l_returnflag"], "l_partkey")
    parts = [lines.where(F.col("l_returnflag") == f) for f in ("A", "N")] + [lines.where(F.col("l_returnflag") == "R").drop("l_discount")]
    both = C.union_tables(parts).select("*", (F.col("l_quantity") > 40).alias("high_interest_screen"), (F.col("l_discount") * 1000).alias("pident"), F.col("l_extendedprice").alias("palm_score"), F.col("l_linenumber").alias("aa_length"))
    keys = C.rank_all(both, "l_orderkey", "l_partkey", "l_suppkey", "l_tax", "l_shipdate")
    top = both.orderBy(*keys).limit(50)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*keys))).select("rank", "l_orderkey", "l_partkey", "l_returnflag", F.round("pident", 6).alias("pident"), F.round("palm_score", 2).alias("palm_score"))


def pair_enumeration(spark: SparkSession, d: str) -> DataFrame:
    """Per part, pairs of its distinct (supplier, order) members i < j of different suppliers: how many, and a digest that does not depend on order."""
    members = t(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey").distinct()
    found = replication.pairs(members, "l_partkey", "l_suppkey", "l_suppkey", "l_orderkey", carry=("l_orderkey",))
    parts = zip(("i_1", "i_2", "l_suppkey_1", "l_suppkey_2", "l_orderkey_1", "l_orderkey_2"), (1_000_003, 10_007, 31, 37, 41, 43))
    mixed = sum(F.col(c).cast("long") * k for c, k in parts) % 1_000_000_007
    return found.groupBy("l_partkey").agg(F.count("*").alias("pairs"), F.sum(mixed).alias("digest"))


def pair_candidates(spark: SparkSession, d: str) -> DataFrame:
    """lineage=role, run=conversation: all pairs of turns of different conversations that may be strong, by their letters and pairs of adjacent letters."""
    turns = t(spark, d, "conversations").where(F.col("text").isNotNull()).select("role", "conv_id", "turn", F.concat_ws("_", "conv_id", "turn").alias("query"), "text")
    kinds = [("query", turns.select(F.col("query").alias("id"), F.col("text").alias("seq")), "aa", replication.PROTEIN)]
    found = replication.candidate_pairs(turns.drop("text"), "role", "conv_id", ["conv_id", "turn"], kinds, ("turn",))
    return found.select("role", "i_1", "i_2", "conv_id_1", "turn_1", "conv_id_2", "turn_2")


def pair_score_strong(spark: SparkSession, d: str) -> DataFrame:
    """lineage=first six letters of a turn, run=conversation: all pairs of turns of different conversations, each pair of texts aligned: identity, coverage and strong flag."""
    turns = t(spark, d, "conversations").where(F.col("text").isNotNull()).select(F.lower(F.substring("text", 1, 6)).alias("opening"), "conv_id", "turn", "text", replication.digest(F.col("text")).alias("digest"))
    pairs = replication.pairs(turns, "opening", "conv_id", "conv_id", "turn", "text", carry=("turn", "digest"))
    scores = replication.scored_texts(pairs, "digest_1", "digest_2", turns.select("digest", F.col("text").alias("seq")).distinct(), replication.PROTEIN, "aa")
    scored = pairs.select("opening", "conv_id_1", "turn_1", "conv_id_2", "turn_2", "digest_1", "digest_2").join(scores, ["digest_1", "digest_2"]).drop("digest_1", "digest_2")
    strong = (F.col("aa_identity") >= 90) & (F.least("aa_coverage_1", "aa_coverage_2") >= 50)
    return scored.withColumn("strong", strong)


def candidate_table(spark: SparkSession, d: str) -> DataFrame:
    """query=part with a frame, contig=part with sizes over 5, annotation from the part's columns, hit=first lineitem of each part; 25 columns."""
    part = t(spark, d, "part")
    query = F.concat(F.lit("c"), F.col("p_partkey"), F.when(F.col("p_size") % 2 == 0, F.lit("_frame=1")).otherwise(F.lit("")))
    run = [F.lit("R1").alias("accession"), F.col("p_brand").alias("target_label"), F.col("p_type").alias("bioproject"), F.col("p_name").alias("organism")]
    aa = part.select(*run, query.alias("query"), (F.col("p_size") * 5).alias("aa_length"))
    items = F.concat(query, F.lit("\tscore="), F.when(F.col("p_size") > 10, F.format_string("%.2f", F.col("p_retailprice") - 900)).otherwise(F.lit("")), F.lit("\trdrp_score=80\tpssm_total_score=3\tgene="), F.col("p_type"), F.lit("\torder=ABC\tpp_start="), F.col("p_size"), F.lit("\tpp_end=x\tgroup=g"))
    annotations = readers.annotations(part.where("p_size > 3").select(F.col("p_partkey").alias("ordinal"), items.alias("value")))
    names = part.select(F.col("p_partkey").alias("l_partkey"), query.alias("query"))
    hits = _first_lines(spark, d).join(names, "l_partkey").select("query", "subject", "pident", "qcov", F.lit(50.0).alias("scov"), F.lit(0.001).alias("evalue"), "bitscore")
    contigs = part.where("p_size > 5").select(F.concat(F.lit("c"), F.col("p_partkey")).alias("id"), F.repeat(F.lit("A"), F.col("p_size")).alias("seq"))
    made = C.candidate_table(aa, annotations, hits, contigs)
    r = lambda c: F.round(c, 6).alias(c)
    return made.select(*(r(c) if c in ("palm_score", "pssm_score", "pident", "qcov", "bitscore") else c for c in made.columns))


def lineage_rollup(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders").withColumn("complete", F.col("o_totalprice") > 1000)
    return replication.lineage_rollup(orders, "o_custkey", "o_orderstatus", "complete", "o_totalprice")


def depth_from_intervals(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    hour = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0))
    return depth.depth_from_intervals(e.select(F.col("user_id").alias("reference"), hour.alias("start"), (hour + 1 + k).alias("end")))


def alignment_depth(spark: SparkSession, d: str) -> DataFrame:
    """Events as alignments of some hours with flags; those that depth leaves out do not count."""
    e = t(spark, d, "events")
    hour = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return depth.alignment_depth(e.select(F.col("user_id").alias("reference"), hour.alias("start"), (hour + 1 + F.col("event_id") % 7).alias("end"), (F.col("event_id") % 4096).alias("flag")))


def reference_counts(spark: SparkSession, d: str) -> DataFrame:
    """references=customers, alignments=events by user with flags."""
    e = t(spark, d, "events").select(F.col("user_id").alias("reference"), (F.col("event_id") % 4096).alias("flag"))
    return depth.reference_counts(e, t(spark, d, "customer").select(F.col("c_custkey").alias("reference"), F.length("c_name").alias("length")))


def depth_summary(spark: SparkSession, d: str) -> DataFrame:
    """reference=supplier, pos=ship day from the first day on, depth=lines of that day by return flag, of which the last flag counts, length=all days."""
    lines = t(spark, d, "lineitem").select("l_suppkey", F.unix_date(F.to_date("l_shipdate")).alias("day"), F.col("l_returnflag").alias("ordinal"))
    range_ = lines.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    daily = lines.groupBy(F.col("l_suppkey").alias("reference"), "day", "ordinal").agg(F.count("*").alias("depth")).crossJoin(F.broadcast(range_))
    references = t(spark, d, "supplier").select(F.col("s_suppkey").alias("reference")).crossJoin(F.broadcast(range_)).select("reference", (F.col("hi") - F.col("lo") + 1).cast("long").alias("length"))
    return depth.depth_summary(daily.select("reference", (F.col("day") - F.col("lo") + 1).alias("pos"), "depth", "ordinal"), references, order=("ordinal",))


def read_counts(spark: SparkSession, d: str) -> DataFrame:
    flag, mapq = (F.col("event_id") % 4096), (F.col("event_id") % 61)
    return t(spark, d, "events").groupBy(F.col("user_id").alias("reference")).agg(F.count("*").alias("reads"), *depth.read_counts(flag, mapq))


def _support(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("reference"), F.col("l_suppkey").alias("run"))
    return lines.agg(F.max(F.col("l_quantity") / 50).alias("breadth_1x"), (F.count("*") * 5).alias("mean_depth"), F.sum("l_quantity").alias("mapped_mapq20"))


def supported_runs(spark: SparkSession, d: str) -> DataFrame:
    return depth.supported_runs(_support(spark, d))


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """lineage=part, hits=first lineitem of each flag, motifs=name, type, brand; replication by size."""
    part = t(spark, d, "part").select(F.col("p_partkey").alias("lineage"), F.col("p_name").alias("motif_A"), F.when(F.col("p_size") > 3, F.col("p_type")).alias("motif_B"), F.col("p_brand").alias("motif_C"), (F.col("p_retailprice") / 100).alias("pident"))
    rep = t(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("lineage"), F.when(F.col("p_size") > 20, "strong").otherwise("not_established").alias("cross_run_replication"), F.col("p_size").alias("distinct_runs"), F.col("p_size").alias("strong_cross_run_pairs"), F.when(F.col("p_size") % 3 > 0, F.col("p_size") * 1.5).alias("minimum_palmdb_identity"))
    hit = lambda flag: _first_lines(spark, d, flag).select(
        F.col("l_partkey").alias("lineage"), F.col("subject").alias("saccver"), "pident", F.col("qcov").alias("qcovs"), "bitscore", F.when(F.col("qcov") > 20, 0.0).otherwise(1.0).alias("evalue"),
        F.col("l_linestatus").alias("sscinames"), F.when(F.col("l_linestatus") == "O", "some Virus").otherwise("cell").alias("stitle"),
    )
    return DC.evidence(part, rep, hit("A"), hit("N"), hit("R"), supported_runs(spark, d))


def decision_label(spark: SparkSession, d: str) -> DataFrame:
    return DC.decide(_evidence(spark, d)).select("lineage", "motif_complete", "replication", "supported_run_count", "decision")


def decision_table(spark: SparkSession, d: str) -> DataFrame:
    """The final table of 22 text columns over the same evidence."""
    out = DC.decision_table(_evidence(spark, d))
    return out.withColumn("lineage", F.col("lineage").cast("string"))


def lineage_audit(spark: SparkSession, d: str) -> DataFrame:
    return report.lineage_audit(decision_table(spark, d))


def _annotation_lines(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    line = F.concat(F.lit("ev"), F.col("event_id"), F.lit("\tbare\tscore="), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.coalesce(k, F.lit(""))), F.lit("\tpalm_score=7\tgene=a=b\tgene="), F.col("event_type"))
    return t(spark, d, "events").select(F.col("event_id").alias("ordinal"), line.alias("value"))


def annotation_map(spark: SparkSession, d: str) -> DataFrame:
    a = readers.annotations(_annotation_lines(spark, d))
    score = X.first_nonblank(F.try_element_at("attrs", F.lit("score")), F.try_element_at("attrs", F.lit("palm_score"))).try_cast("double")
    return a.select("id", score.alias("score"), F.try_element_at("attrs", F.lit("gene")).alias("gene"), F.size("attrs").alias("n"))


def hit_table(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as headerless lines of 12 or, for every fifth order, 11 fields; short rows are skipped, bad numbers are null."""
    fields = ["l_partkey", "l_suppkey", F.when(F.col("l_linenumber") == 2, "n/a").otherwise(F.col("l_quantity").cast("string")), "l_linenumber", F.lit(1), F.lit(2), "l_discount", "l_extendedprice", "l_tax", F.lit(3), F.lit(4)]
    line = F.concat_ws("\t", *[F.col(f).cast("string") if isinstance(f, str) else f for f in fields])
    line = F.when(F.col("l_orderkey") % 5 == 0, line).otherwise(F.concat(line, F.lit("\t5")))
    rows = readers.hits(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("ordinal"), line.alias("value")), readers.HITS_1)
    return rows.groupBy("query").agg(F.count("*").alias("hits"), F.count("pident").alias("with_identity"), F.round(F.sum("pident"), 2).alias("identity"), F.max("qend").alias("qend"))


def keyed_json(spark: SparkSession, d: str) -> DataFrame:
    """One object of two keyed values for each event."""
    value = F.concat(F.lit('{"a'), F.col("event_id"), F.lit('": '), F.col("props"), F.lit(', "b": {"k": 1}}'))
    rows = readers.keyed_json(t(spark, d, "events").where(F.col("props").isNotNull()).select(value.alias("value")), "struct<k:bigint>")
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("k").alias("k"), F.max("position").alias("position"))


def zip_lists(spark: SparkSession, d: str) -> DataFrame:
    """Packed lists of suppliers, lines and (shorter) taxes of an order, zipped and exploded as a download plan."""
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.struct("l_suppkey", "l_partkey"))).alias("x"))
    url = F.array_join(F.transform("x", lambda e: F.when(e["l_suppkey"] % 7 == 0, "").when(e["l_suppkey"] % 2 == 0, F.concat(F.lit("http://h/"), e["l_suppkey"])).otherwise(F.concat(F.lit("h/"), e["l_suppkey"]))), ";")
    part = lambda y: F.array_join(F.transform(y, lambda e: e["l_partkey"].cast("string")), ";")
    return readers.download_plan(rows, url, part(F.col("x")), part(F.slice("x", 1, 1)), "l_orderkey")


def safe_names(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", X.safe_name(F.col("url")).alias("name"))


def revcomp(spark: SparkSession, d: str) -> DataFrame:
    bases = F.regexp_replace(F.upper("text"), "[^ACGTU]", "")
    return t(spark, d, "documents").select("doc_id", F.md5(X.reverse_complement(bases)).alias("revcomp_md5"))


def digest_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Digests of documents against an expected list: some wrong, some missing on either side."""
    docs = t(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.sha2("text", 256).alias("sha256"))
    k = F.col("doc_id") % 10
    expected = docs.where(k != 3).select("doc_id", F.when(k == 5, "0").otherwise(F.col("sha256")).alias("sha256"))
    return manifest.verify(expected, docs.where(k != 7), "doc_id", "sha256").groupBy("status").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def _pose_summary(spark: SparkSession, d: str) -> DataFrame:
    poses = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("ligand_std"), F.col("l_linestatus").alias("grid_category"), "l_extendedprice", "l_tax", (F.col("l_quantity") > 10).alias("dual_chain"), (F.col("l_quantity") > 15).alias("strong_cleft"))
    return docking.pose_summary(poses, "ligand_std", "grid_category", "l_extendedprice", ["dual_chain", "strong_cleft"], ["l_tax"])


def pose_summary(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c, k=4: F.round(c, k).alias(c)
    return _pose_summary(spark, d).select("ligand_std", F.coalesce("grid_category", F.lit("all")).alias("grid_category"), "overall", "n", r("mean_score"), r("sd_score"), r("dual_chain_fraction"), r("strong_cleft_fraction"), r("mean_l_tax", 6))


def pose_rmsd(spark: SparkSession, d: str) -> DataFrame:
    """group=label and vec_id in blocks of 8, pose=vec_id, one atom for each component of the embedding."""
    e = t(spark, d, "embeddings").where(F.col("embedding").isNotNull())
    atoms = e.select("label", F.floor(F.col("vec_id") / 200).alias("block"), "vec_id", F.posexplode("embedding").alias("atom", "x"))
    out = docking.pose_rmsd(atoms.withColumn("x", F.col("x").cast("double")), ["label", "block"], "vec_id", "atom", ["x"], docking.ContactRule(low_rmsd=0.16))
    r = lambda c: F.round(c, 5).alias(c)
    return out.select("label", "block", "n_poses", r("mean_pairwise_rmsd"), r("median_pairwise_rmsd"), r("max_pairwise_rmsd"), "pose_cluster_low_rmsd")


def _points(spark: SparkSession, d: str) -> DataFrame:
    xyz = [(F.col("embedding")[i].cast("double") * 20).alias(c) for i, c in enumerate("xyz")]
    return t(spark, d, "embeddings").where(F.col("embedding").isNotNull()).select("vec_id", F.col("label").alias("system"), *xyz)


def contact_join(spark: SparkSession, d: str) -> DataFrame:
    """Points of one label no farther apart than the radius, by cells; counts by parity of the neighbour."""
    p = _points(spark, d)
    met = docking.within(p, p, ["system"], 1.0).where("a.vec_id <> b.vec_id")
    odd = F.col("b.vec_id") % 2
    return met.groupBy(F.col("a.vec_id").alias("vec_id")).agg(F.count_if(odd == 1).alias("odd"), F.count_if(odd == 0).alias("even"), F.round(F.min("distance"), 6).alias("nearest"))


def verdict_table(spark: SparkSession, d: str) -> DataFrame:
    roles = spark.createDataFrame([("A", "Main", 1, 24.0), ("N", "Comparison", 0, 22.0), ("R", "Control", 2, 20.0)], "ligand_std string, role_text string, priority_order int, mean_heavy_atoms double")
    whole = _pose_summary(spark, d).where("overall = 1").withColumn("low_rmsd_system_fraction", F.col("mean_l_tax") * 12)
    out = docking.final_decision(whole, F.broadcast(roles))
    return out.select("ligand_std", "priority_order", "n", F.round("mean_LE", 3).alias("mean_LE"), F.round(100 * F.col("dual_chain_fraction"), 0).cast("int").alias("dual_percent"), "stage16_preliminary_verdict")


def grid_gate(spark: SparkSession, d: str) -> DataFrame:
    """Centres of label and parity; comparable if near each other."""
    c = _points(spark, d).withColumn("state", F.col("vec_id") % 2).groupBy("system", "state").agg(*(F.avg(a).alias(a) for a in "xyz"))
    return docking.grid_gate(c, ["system"], "state", 0.5)


def stream_filter(spark: SparkSession, d: str) -> DataFrame:
    """The sequence filter as a stream over the files of documents, run to its end into the shared folder."""
    path = f"{d}/documents.parquet"
    schema = spark.read.parquet(path).schema
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "*.parquet").load(f"{d}/documents.parque[t]")
    rows = stream.select("doc_id", sequences.clean(F.col("text")).alias("seq"))
    query = filter_stream(rows, sequences.passes(F.col("seq"), 600, 100_000, LETTERS, 0.9), f"{base}/out", f"{base}/checkpoint")
    query.awaitTermination()
    return spark.read.schema("doc_id bigint, seq string").parquet(f"{base}/out").select("doc_id", F.length("seq").cast("long").alias("length"))
