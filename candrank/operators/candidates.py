"""Candidates: annotation and first hit joined on, novelty label, ranking, distributions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candrank.functions.exprs import contig_key, first_nonblank


@dataclass(frozen=True)
class NoveltyRule:
    """Fixed values of the labels and their upper bounds of identity."""

    no_hit: str = "no_PALMdb_hit"
    weak: str = "weak_partial_hit"
    least_qcov: float = 40.0
    steps: tuple[tuple[float, str], ...] = ((35.0, "very_divergent_lt35pct"), (50.0, "divergent_35_50pct"), (70.0, "moderate_50_70pct"), (90.0, "close_70_90pct"))
    last: str = "PALMdb_sOTU_level_ge90pct"
    interest_score: float = 75.0
    interest_pident: float = 50.0
    interest_length: int = 90


def _below(c: Column, bound: float) -> Column:
    """c < bound, false for null and nan."""
    return F.coalesce((c < bound) & ~F.isnan(c), F.lit(False))


def novelty_label(pident: Column, qcov: Column, rule: NoveltyRule = NoveltyRule()) -> Column:
    out = F.when(pident.isNull(), rule.no_hit).when(_below(qcov, rule.least_qcov), rule.weak)
    for bound, label in rule.steps:
        out = out.when(_below(pident, bound), label)
    return out.otherwise(rule.last)


def high_interest(score: Column, pident: Column, qcov: Column, length: Column, rule: NoveltyRule = NoveltyRule()) -> Column:
    """nan fails each comparison, null passes each."""
    at_least = lambda c, bound: c.isNull() | ((c >= bound) & ~F.isnan(c))
    return at_least(score, rule.interest_score) & (pident.isNull() | _below(pident, rule.interest_pident)) & at_least(qcov, rule.least_qcov) & F.coalesce(length >= rule.interest_length, F.lit(False))


RUN = ("accession", "target_label", "bioproject", "organism")


def candidate_table(aa: DataFrame, annotations: DataFrame, hits: DataFrame, contigs: DataFrame) -> DataFrame:
    """The 25 columns of candidates: aa (query, aa_length and, if there, those of RUN) with annotation, first hit and contig.

    If all four frames have an accession, candidates of many runs are joined within their runs; columns of RUN that aa
    lacks are null. The long sequences themselves are not carried.
    """
    by = ["accession"] if all("accession" in df.columns for df in (aa, annotations, hits, contigs)) else []
    a = annotations.select(*by, F.col("id").alias("query"), "attrs")
    n = contigs.select(*by, F.col("id").alias("nt_contig"), F.length("seq").alias("nt_length"))
    best = hits.select(*by, "query", "subject", "pident", "qcov", "scov", "evalue", "bitscore")
    attr = lambda k: F.try_element_at("attrs", F.lit(k))
    run = [c if c in aa.columns else F.lit(None).cast("string").alias(c) for c in RUN]
    joined = aa.select(*run, "query", "aa_length").join(a, [*by, "query"], "left").join(best, [*by, "query"], "left").withColumn("nt_contig", contig_key(F.col("query"))).join(n, [*by, "nt_contig"], "left")
    score = first_nonblank(*map(attr, ("score", "palm_score", "pa_score", "rdrp_score"))).try_cast("double")
    return joined.select(
        *RUN, "query", "nt_contig", F.coalesce("nt_length", F.lit(0)).alias("nt_length"), "aa_length", score.alias("palm_score"),
        F.coalesce(attr("pssm_score"), attr("pssm_total_score")).try_cast("double").alias("pssm_score"),
        attr("gene").alias("gene"), attr("order").alias("motif_order"), attr("confidence").alias("confidence"), attr("group").alias("group_guess"),
        attr("pp_start").try_cast("int").alias("palmprint_start"), attr("pp_end").try_cast("int").alias("palmprint_end"), attr("motifs").alias("motifs"),
        F.col("subject").alias("best_palmdb_sotu"), "pident", "qcov", "scov", "evalue", "bitscore",
        novelty_label(F.col("pident"), F.col("qcov")).alias("novelty_screen"),
        high_interest(score, F.col("pident"), F.col("qcov"), F.col("aa_length")).alias("high_interest_screen"),
    )


def rank_within(df: DataFrame, *ties: str) -> DataFrame:
    """Order inside one accession: interest, identity with missing first, length."""
    return df.orderBy(F.desc("high_interest_screen"), F.asc_nulls_first("pident"), F.desc("aa_length"), *ties)


def rank_all(df: DataFrame, *ties: str) -> list[Column]:
    """Sort keys over all accessions; missing identity sorts as -1, missing score and length as 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).desc()
    return [F.desc("high_interest_screen"), F.coalesce("pident", F.lit(-1.0)).asc(), zero("palm_score"), zero("aa_length"), *map(F.col, ties)]


def distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(label)


def accession_summary(df: DataFrame, accessions: DataFrame | None = None) -> DataFrame:
    """(accession, candidates, high_interest, novelty_counts); accessions without candidates count 0."""
    each = df.groupBy("accession", "novelty_screen").agg(F.count("*").alias("n"), F.count_if("high_interest_screen").alias("hi"))
    made = each.groupBy("accession").agg(
        F.sum("n").alias("candidates"), F.sum("hi").alias("high_interest"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("novelty_screen", "n")))).alias("novelty_counts"),
    )
    if accessions is None:
        return made
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return accessions.join(made, "accession", "left").select("accession", zero("candidates"), zero("high_interest"), F.coalesce("novelty_counts", F.create_map().cast("map<string,bigint>")).alias("novelty_counts"))


def union_tables(tables: list[DataFrame], strict: bool = False) -> DataFrame:
    """UNION ALL by name; strict refuses a later table with a column that the first lacks."""
    if strict and (extra := {c for t in tables[1:] for c in t.columns} - set(tables[0].columns)):
        raise ValueError(f"columns not in the first table: {sorted(extra)}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
