"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.sources.shared import shared_dir

#: Fixed by the contracts: white space that ends a word.
WORD_BREAK = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, by Spark's reader only, so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str, **options: int | str) -> DataFrame:
    """Cut the lineage by a table in the shared folder: computed once, read again after the loss of an executor. options go to the writer."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Arrow batches of at most so many bytes (or one row) for what is written meanwhile; a worker and its executor hold several copies of one."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3 is 1; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only what is read: further columns, whatever they are named, go no further. Null text is empty text."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def map_texts(docs: DataFrame, fn: Callable[[list[str]], dict], schema: str) -> DataFrame:
    """Arrow batches of (doc_id, text, ...) to rows of doc_id and the columns that fn makes of the texts.

    doc_id goes through untouched, so nulls and large values stay exact.
    """
    kinds = {f.name: f for f in _arrow_schema(docs.sparkSession, schema)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(made[k], type=f.type) for k, f in kinds.items())],
                names=["doc_id", *kinds],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
