"""The corpus pipeline over documents: quality rules, line dedup, near duplicates, secrets, packing.

Each stage is a Spark job that is written as Parquet and read again by the next. All but the last return the columns of
documents; where a stage changes text, n_chars follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.llm.common import materialize, table
from candrank.llm.lines import drop_recurring
from candrank.llm.packing import pack
from candrank.llm.quality import keep_good
from candrank.llm.secrets import redact
from candrank.llm.simhash import similar_documents


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines stay in their first document only."""
    return _counted(drop_recurring(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 0.8 or more of their five-word shingles the row of the least doc_id stays; rows of equal doc_id count as different rows."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document")
    rows = materialize(docs.select(whole, F.monotonically_increasing_id().alias("row")), "rows")  # a later scan may deal rows otherwise
    found = similar_documents(rows.select(F.struct("document.doc_id", "row").alias("doc_id"), "document.text"))
    first = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id.row")
    return rows.join(first, "row", "left_semi").select("document.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; documents without one stay as they are."""
    return _counted(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their sequences."""
    return pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("secrets", secrets), ("packing", packing)]
#: SQL has no byte-pair encoding and no XXH64; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
