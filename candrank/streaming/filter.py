"""The sequence filter as a stream: stateless, bounded memory, restarts from its checkpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from candrank.operators.sequences import clean, passes
from candrank.sources.readers import fasta


def fasta_stream(spark: SparkSession, path: str) -> DataFrame:
    """FASTA records as they land. Streams carry no row order, so a file's text before its first header is not told from a record; it has no sequence lines that pass the filter unless it holds some."""
    raw = spark.readStream.format("text").option("lineSep", "\n>").load(path)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    return fasta(raw.select(place.alias("ordinal"), "value", F.lit(False).alias("is_first")))


def filter_stream(rows: DataFrame, keep: Column, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the rows that pass to out, with counters as observed metrics, and ends when all there is has been read."""
    seen = rows.observe("filter_stats", F.count(F.lit(1)).alias("records_seen"), F.count_if(keep).alias("records_kept"))
    return seen.where(keep).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def filter_fasta_stream(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    rows = fasta_stream(spark, path).withColumn("seq", clean(F.col("seq"))).drop("ordinal")
    return filter_stream(rows, passes(F.col("seq")), out, checkpoint)
