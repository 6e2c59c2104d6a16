"""Report tables: headline counts, label distribution, ranked top n with placeholders, flag counts, manifest of outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candrank.functions.exprs import all_of, first_nonblank, has_flags, lacks_flags, shown
from candrank.operators.candidates import rank_all
from candrank.operators.manifest import file_manifest


def headline(summaries: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: completed accessions, candidates, high interest."""
    done = summaries.agg(F.count("*").alias("completed_accessions"))
    return done.crossJoin(candidates.agg(F.count("*").alias("candidates"), F.count_if("high_interest_screen").alias("high_interest")))


def ranked_report(candidates: DataFrame, n: int, columns: list[str], *ties: str) -> DataFrame:
    """The first n over all accessions with rank numbers; missing cells show NA."""
    keys = rank_all(candidates, *ties)
    top = candidates.orderBy(*keys).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*keys))).select("rank", *(shown(F.col(c)).alias(c) for c in columns))


def flag_counts(alignments: DataFrame, *keys: str) -> DataFrame:
    """Counts of each alignment flag bit in one pass."""
    bits = {"paired": 0x1, "proper": 0x2, "unmapped": 0x4, "reverse": 0x10, "secondary": 0x100, "qc_fail": 0x200, "duplicate": 0x400, "supplementary": 0x800}
    return alignments.groupBy(*keys).agg(F.count("*").alias("total"), *(F.count_if(has_flags(F.col("flag"), b)).alias(name) for name, b in bits.items()))


def flag_summary(alignments: DataFrame, *keys: str) -> DataFrame:
    """(keys, category, passed, failed): the categories of a flag summary, each for alignments that passed the quality check and that failed it, in one pass.

    Categories from paired on count primary alignments only (neither secondary nor supplementary), as such summaries do.
    """
    flag = F.col("flag")
    on = lambda *bits: all_of(*(has_flags(flag, b) for b in bits))
    mapped, primary, paired = lacks_flags(flag, 0x4), lacks_flags(flag, 0x100 | 0x800), lacks_flags(flag, 0x100 | 0x800) & on(0x1)
    both = paired & mapped & lacks_flags(flag, 0x8)
    categories = {
        "total": F.lit(True), "primary": primary, "secondary": on(0x100), "supplementary": on(0x800) & lacks_flags(flag, 0x100), "duplicates": on(0x400), "primary duplicates": primary & on(0x400),
        "mapped": mapped, "primary mapped": primary & mapped, "paired": paired, "read1": paired & on(0x40), "read2": paired & on(0x80), "properly paired": paired & mapped & on(0x2),
        "with itself and mate mapped": both, "singletons": paired & mapped & on(0x8),
    }
    failed = on(0x200)
    counts = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(name).alias("category"), F.count_if(c & ~failed).alias("passed"), F.count_if(c & failed).alias("failed")) for i, (name, c) in enumerate(categories.items())))
    return alignments.groupBy(*keys).agg(counts.alias("x")).select(*keys, F.inline("x")).drop("i")


def lineage_audit(decisions: DataFrame) -> DataFrame:
    """One row for each row of decision_table, as a report shows it: missing hits are `none`, missing numbers NA."""
    pair = lambda h: F.concat_ws("/", shown(F.col(f"{h}_hit_identity")), shown(F.col(f"{h}_hit_qcov")))
    viral = first_nonblank(F.col("viral_hit_taxon"), F.col("viral_hit_accession"), F.lit("none"))
    return decisions.select(
        "lineage", "decision", F.col("assembly_distinct_runs").alias("assembly_runs"), F.col("raw_supported_run_count").alias("raw_read_runs"),
        viral.alias("current_viral_hit"), pair("viral").alias("protein_identity_qcov"), pair("nt").alias("nt_identity_qcov"),
    )


def output_manifest(spark: SparkSession, folder: str, to: str) -> DataFrame:
    """Writes (path, bytes, sha256) of every file in folder to `to`; returns the digests of what was written there."""
    file_manifest(spark, folder).select("path", "bytes", "sha256").coalesce(1).write.json(to)
    return file_manifest(spark, to)
