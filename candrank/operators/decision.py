"""Five-way decision over all evidence of a lineage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DecisionRule:
    """Fixed values of the thresholds and labels."""

    protein: tuple[float, float] = (90.0, 80.0)
    nucleotide: tuple[float, float] = (95.0, 80.0)
    override: float = 1.20
    needle: str = "virus"
    evalue: float = 1e-5
    runs: int = 2
    known: str = "currently_known_or_near_identical_sequence"
    cellular: str = "rejected_or_ambiguous_cellular_match"
    supported: str = "supported_unreported_RdRP_lineage_candidate"
    replicated: str = "assembly_replicated_RdRP_candidate_raw_support_incomplete"
    open: str = "insufficient_validation"


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def near_identical(hit: str, bounds: tuple[float, float]) -> Column:
    return (_zero(F.col(f"{hit}.pident")) >= bounds[0]) & (_zero(F.col(f"{hit}.qcovs")) >= bounds[1])


def overridden(viral: str, any_: str, rule: DecisionRule) -> Column:
    """The unrestricted best hit outweighs the viral one and does not name the needle; any such hit where there is no viral one."""
    named = F.contains(F.lower(F.concat_ws(" ", F.col(f"{any_}.sscinames"), F.col(f"{any_}.stitle"))), F.lit(rule.needle))
    better = (_zero(F.col(f"{any_}.bitscore")) > rule.override * _zero(F.col(f"{viral}.bitscore"))) & (F.col(f"{any_}.saccver") != F.col(f"{viral}.saccver"))
    there = lambda h: F.col(h).isNotNull()
    return F.when(there(any_) & there(viral), better & ~named).when(there(any_), ~named).otherwise(False)


def decide(lineages: DataFrame, rule: DecisionRule = DecisionRule()) -> DataFrame:
    """lineages (lineage, motif_complete, replication, supported_run_count, viral, any, nt): the last three are structs of best hits or null."""
    known = near_identical("viral", rule.protein) | near_identical("any", rule.protein) | near_identical("nt", rule.nucleotide)
    base = F.col("motif_complete") & (F.coalesce("replication", F.lit("")) == "strong") & F.col("viral").isNotNull() & (F.coalesce("viral.evalue", F.lit(1.0)) <= rule.evalue)
    raw = F.coalesce("supported_run_count", F.lit(0)) >= rule.runs
    label = F.when(known, rule.known).when(overridden("viral", "any", rule), rule.cellular).when(base & raw, rule.supported).when(base, rule.replicated).otherwise(rule.open)
    return lineages.withColumn("decision", label)


def evidence(manifest: DataFrame, replication: DataFrame, viral: DataFrame, any_: DataFrame, nt: DataFrame, runs: DataFrame) -> DataFrame:
    """Left joins of the lineage manifest with replication, three best-hit tables (lineage and hit columns) and supported runs (reference, ...)."""
    packed = lambda df, name: df.select("lineage", F.struct(*(c for c in df.columns if c != "lineage")).alias(name))
    identity = F.col("minimum_palmdb_identity") if "minimum_palmdb_identity" in replication.columns else F.lit(None).cast("double").alias("minimum_palmdb_identity")
    out = manifest.join(replication.select("lineage", F.col("cross_run_replication").alias("replication"), "distinct_runs", "strong_cross_run_pairs", identity), "lineage", "left")
    for df, name in ((viral, "viral"), (any_, "any"), (nt, "nt")):
        out = out.join(packed(df, name), "lineage", "left")
    out = out.join(runs.withColumnRenamed("reference", "lineage"), "lineage", "left")
    filled = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("motif_A", "motif_B", "motif_C")]
    return out.withColumn("motif_complete", filled[0] & filled[1] & filled[2]).withColumn("replication", F.coalesce("replication", F.lit("missing"))).withColumn("supported_run_count", F.coalesce("supported_run_count", F.lit(0)))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _percent(c: Column) -> Column:
    """Three decimals, empty if missing."""
    return F.when(c.isNull(), "").otherwise(F.format_string("%.3f", c.cast("double")))


#: Columns of best hits and their names in the final table; the tables of hits, their names there, and how many columns.
HIT_COLUMNS = (("saccver", "accession"), ("pident", "identity"), ("qcovs", "qcov"), ("sscinames", "taxon"), ("stitle", "title"))
HIT_TABLES = (("viral", "viral", 5), ("any", "unrestricted", 5), ("nt", "nt", 3))


def _hit_columns() -> list[Column]:
    out = []
    for table, name, n in HIT_TABLES:
        for c, to in HIT_COLUMNS[:n]:
            shown = _percent if c in ("pident", "qcovs") else _text
            out.append(shown(F.col(f"{table}.{c}")).alias(f"{name}_hit_{to}"))
    return out


def decision_table(found: DataFrame, rule: DecisionRule = DecisionRule()) -> DataFrame:
    """The final table of 22 text columns: decision and the evidence behind it; what is missing is empty. found is as evidence() makes it; manifests may have pident."""
    own = F.col("pident") if "pident" in found.columns else F.lit(None).cast("double")
    protein = near_identical("viral", rule.protein) | near_identical("any", rule.protein)
    return decide(found, rule).select(
        "lineage", "decision", F.col("replication").alias("assembly_cross_run_replication"), F.coalesce(F.col("distinct_runs").cast("string"), F.lit("0")).alias("assembly_distinct_runs"),
        F.col("supported_run_count").cast("string").alias("raw_supported_run_count"), _text(F.col("supported_runs")).alias("raw_supported_runs"),
        _percent(F.coalesce(F.col("minimum_palmdb_identity"), own)).alias("minimum_PALMdb_2023_identity"), *_hit_columns(),
        protein.cast("string").alias("current_near_identical_protein"), near_identical("nt", rule.nucleotide).cast("string").alias("current_near_identical_nucleotide"),
    )
