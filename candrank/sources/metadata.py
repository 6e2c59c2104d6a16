"""Run metadata: wide or narrow column lists, one row for each run, files to download."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.sources.readers import download_plan, with_ordinal

WIDE = ["run_accession", "study_accession", "sample_accession", "experiment_accession", "scientific_name", "base_count", "read_count", "fastq_ftp", "fastq_md5", "fastq_bytes"]


def run_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The first row of each run; columns that the file does not have are null; an empty file raises.

    Rows are dealt by run, those of one run to eight tasks at most, before their firsts are taken: no task sorts a whole split.
    """
    raw = with_ordinal(spark.read.option("header", True).option("sep", "\t").csv(path))
    columns = [F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in WIDE]
    rest = F.struct(*(c for c in WIDE if c != "run_accession"))
    dealt = raw.select("ordinal", *columns).repartition("run_accession", F.pmod("ordinal.n", F.lit(8)))
    rows = dealt.groupBy("run_accession").agg(F.min_by(rest, "ordinal").alias("row")).select("run_accession", "row.*")
    if raw.isEmpty():
        raise ValueError(f"no run in {path}")
    number = lambda c: F.col(c).try_cast("bigint").alias(c)
    return rows.select(*(number(c) if c in ("base_count", "read_count") else F.col(c) for c in WIDE))


def fastq_plan(runs: DataFrame, *more: str) -> DataFrame:
    """(run_accession, more, url, md5, bytes): the files of each run, with more columns of the run."""
    return download_plan(runs, F.col("fastq_ftp"), F.coalesce("fastq_md5", F.lit("")), F.coalesce("fastq_bytes", F.lit("")), "run_accession", *more)
