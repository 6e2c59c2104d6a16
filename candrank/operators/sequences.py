"""Sequence filter and its counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candrank.functions.exprs import alphabet_share


def clean(seq: Column) -> Column:
    return F.upper(F.replace(seq, F.lit(" "), F.lit("")))


def passes(seq: Column, least: int = 600, most: int = 100_000, alphabet: str = "ACGTUN", share: float = 0.95) -> Column:
    """On a cleaned sequence: length within bounds, not empty, enough characters of the alphabet."""
    return F.coalesce((F.length(seq) > 0) & F.length(seq).between(least, most) & (alphabet_share(seq, alphabet) >= share), F.lit(False))


def counters(df: DataFrame, seq: str, kept: Column, least: int = 600, most: int = 100_000) -> DataFrame:
    """One row: records seen and kept, bases kept, and the bounds of the filter."""
    n = F.length(seq)
    made = df.agg(F.count("*").alias("records_seen"), F.count_if(kept).alias("records_kept"), F.coalesce(F.sum(F.when(kept, n)), F.lit(0)).alias("bases_kept"))
    return made.select("*", F.lit(least).alias("min_len"), F.lit(most).alias("max_len"))
