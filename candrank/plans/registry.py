"""Queries over the driver's tables, and their SQL."""

from __future__ import annotations

from candrank.plans import jobs, jobs_oracle, oracle
from candrank.plans import queries as Q

ORACLE_SQL = oracle.ORACLE_SQL | jobs_oracle.ORACLE_SQL
QUERIES = {
    name: getattr(Q, name)
    for name in (
        "candidate_rank", "novelty_distribution", "accession_summary", "first_hit", "last_wins", "top_n_distinct", "seq_filter", "seq_filter_stats",
        "fasta_roundtrip", "catalogue_filter", "fallback_append", "multi_table_union", "pair_enumeration", "pair_candidates", "pair_score_strong", "lineage_rollup",
        "depth_from_intervals", "alignment_depth", "depth_summary", "read_counts", "reference_counts", "supported_runs", "decision_label", "decision_table", "lineage_audit", "candidate_table", "annotation_map", "hit_table", "keyed_json",
        "zip_lists", "safe_names", "revcomp", "digest_manifest", "pose_summary", "pose_rmsd", "contact_join", "verdict_table", "grid_gate", "stream_filter",
    )
} | {"run_selection_fewest": Q._selection("fewest"), "run_selection_most": Q._selection("most")} | jobs.QUERIES
