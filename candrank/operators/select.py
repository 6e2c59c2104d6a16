"""Choosing runs from a catalogue: usable runs, one project for each label, smallest runs, fallbacks, cap."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candrank.functions.exprs import blank_to_null, num, strip
from candrank.operators.dedup import diversity_cap, newest


@dataclass(frozen=True)
class RunRules:
    """project_preference: `fewest` runs first (the rule as it runs) or `most` (the rule as it is described)."""

    prefixes: tuple[str, ...] = ("SRR", "ERR", "DRR")
    strategies: tuple[str, ...] = ("RNA-SEQ", "OTHER")
    source: str = "TRANSCRIPTOMIC"
    max_size_mb: float = 4500.0
    runs_a_label: int = 3
    count_cap: int = 10
    total_cap: int = 18
    project_preference: str = "fewest"
    reason: str = "recent replicated RNA-seq"


def usable(rules: RunRules) -> Column:
    """Accession prefix, strategy or source, and size; a missing size counts as too large, nan passes."""
    size = num("size_mb", 1e18)
    return (
        strip(F.col("run")).rlike(f"^({'|'.join(rules.prefixes)})")
        & (F.coalesce(F.upper("library_strategy").isin(*rules.strategies), F.lit(False)) | F.coalesce(F.upper("library_source") == rules.source, F.lit(False)))
        & ((size <= rules.max_size_mb) | F.isnan(size))
    )


def catalogue_filter(runs: DataFrame, organisms: list[str], since: str, until: str, n: int = 200) -> DataFrame:
    """The query part of a catalogue search: organisms, date window, the n newest of each label."""
    return newest(runs.where(F.col("organism").isin(*organisms) & F.col("release_date").between(since, until)), "label", "release_date", n, "run")


def select_runs(runs: DataFrame, rules: RunRules = RunRules()) -> DataFrame:
    """The runs_a_label smallest runs of the preferred project of each label; runs carries an ordinal."""
    clean = runs.where(usable(rules)).withColumn("bioproject", F.coalesce(blank_to_null(F.col("bioproject")), F.lit("unknown")))
    projects = clean.groupBy("label", "bioproject").agg(
        F.least(F.count("*"), F.lit(rules.count_cap)).alias("n"), F.max(F.coalesce("release_date", F.lit(""))).alias("latest"), F.min("ordinal").alias("first")
    )
    n = F.col("n").asc() if rules.project_preference == "fewest" else F.col("n").desc()
    best = F.row_number().over(Window.partitionBy("label").orderBy(n, F.desc("latest"), "first"))
    chosen = projects.withColumn("__k", best).where("__k = 1").select("label", "bioproject")
    kept = clean.join(chosen, ["label", "bioproject"])
    size = num("size_mb", 1e18)
    k = F.row_number().over(Window.partitionBy("label").orderBy(size, "run", "ordinal"))
    return kept.withColumn("k", k).where(F.col("k") <= rules.runs_a_label).withColumn("reason", F.lit(rules.reason))


def append_missing(selected: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """selected, then the fallback rows whose key is not there yet."""
    return selected.unionByName(fallback.join(selected.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def capped(selected: DataFrame, rules: RunRules, *order: str) -> DataFrame:
    return diversity_cap(selected, "label", rules.total_cap, *order)
