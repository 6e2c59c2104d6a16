"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from candrank.llm.bpe import op1_bpe
from candrank.llm.centroids import OP11_SQL, op11_centroid_clusters
from candrank.llm.language import op5_language_id
from candrank.llm.lines import OP3_SQL, op3_line_dedup
from candrank.llm.neighbours import op13_nearest_neighbours
from candrank.llm.packing import op8_packing
from candrank.llm.phrases import OP12_SQL, op12_phrase_mining
from candrank.llm.quality import op7_quality_rules
from candrank.llm.secrets import op2_secret_scan
from candrank.llm.simhash import op9_simhash_dedup
from candrank.llm.substrings import op6_substring_dedup
from candrank.llm.topk import OP4_SQL, op4_topk
from candrank.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_secret_scan": op2_secret_scan,
    "op3_line_dedup": op3_line_dedup,
    "op4_topk": op4_topk,
    "op5_language_id": op5_language_id,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_packing": op8_packing,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}

ORACLE_SQL: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op4_topk": OP4_SQL, "op11_centroid_clusters": OP11_SQL, "op12_phrase_mining": OP12_SQL}
