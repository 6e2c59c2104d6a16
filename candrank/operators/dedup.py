"""Choices that depend on order, by an explicit ordinal: first, last, first n distinct, diversity cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key, the first by order; partial and final hash aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*")


def last_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key, at the place of the key's first: adds first_ordinal."""
    rest = [c for c in df.columns if c not in keys]
    made = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"), F.min(F.struct(*order)).alias("first_ordinal"))
    return made.select(*keys, "__row.*", "first_ordinal")


def top_n_distinct(df: DataFrame, key: str, value: str, n: int, *order: str) -> DataFrame:
    """(key, rank, value): the first n distinct values of each key by first occurrence."""
    firsts = df.groupBy(key, value).agg(F.min(F.struct(*order)).alias("__at"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("__at"))
    return firsts.withColumn("rank", rank).where(F.col("rank") <= n).select(key, "rank", value)


def diversity_cap(df: DataFrame, label: str, cap: int, *order: str) -> DataFrame:
    """At most cap rows: the first of each label, then the rest, both by order, which must tell the rows of a label apart.

    The first of each label is an aggregation and the rest a sorted limit, so no label has to fit in one task.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    rows = df.select(whole, F.col(label).alias("label"), F.struct(*order).alias("place"))
    firsts = rows.groupBy("label").agg(F.min("place").alias("first"))
    marked = rows.join(firsts, rows["label"].eqNullSafe(firsts["label"])).select("row", "place", (F.col("place") != F.col("first")).alias("again"))
    return marked.orderBy("again", "place").limit(cap).select("row.*")


def newest(df: DataFrame, label: str, date: str, n: int, *ties: str | Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.desc(date), *ties))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")
