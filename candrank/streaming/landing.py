"""Candidate tables that land over time: each batch is kept once, and ranks are taken when they are read.

A batch is written to a folder of its own id, over whatever an attempt that broke off had left there; then its id goes into the
ledger. Readers take the batches of the ledger only, so a batch that broke off shows nothing, and one that Spark replays
after a crash, because its own checkpoint had not noted it, is found in the ledger and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LEDGER = "batch bigint, landed bigint"


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, landed): the batches that are whole, and their rows; the ledger is begun where there is none."""
    begun = spark.createDataFrame([], LEDGER)
    begun.write.mode("append").json(f"{folder}/ledger")
    return spark.read.schema(LEDGER).json(f"{folder}/ledger")


def keep_batch(batch: DataFrame, batch_id: int, folder: str) -> None:
    """Writes a batch and then its line of the ledger; a batch that the ledger has is left as it is."""
    spark = batch.sparkSession
    if not ledger(spark, folder).where(F.col("batch") == batch_id).isEmpty():
        return
    path = f"{folder}/batches/batch={batch_id}"
    batch.write.mode("overwrite").parquet(path)
    landed = spark.read.schema(batch.schema).parquet(path).count()
    spark.createDataFrame([(batch_id, landed)], LEDGER).coalesce(1).write.mode("append").json(f"{folder}/ledger")


def land(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Takes what there is of a stream into folder and ends."""
    return rows.writeStream.foreachBatch(lambda batch, i: keep_batch(batch, i, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all batches of the ledger, with the batch of each; an empty frame where none has landed."""
    whole = sorted(r.batch for r in ledger(spark, folder).select("batch").distinct().collect())
    if not whole:
        return spark.createDataFrame([], f"{schema}, batch bigint")
    paths = [f"{folder}/batches/batch={i}" for i in whole]
    return spark.read.schema(f"{schema}, batch bigint").option("basePath", f"{folder}/batches").parquet(*paths)
