"""Queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from dossier.llm import centroid_clustering, collocations, exact_dedup, jaccard_join, language_id, packing, quality_rules, secret_scan, sentencepieces, sharding, substring_dedup, token_counts, weak_quality

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_language_id": language_id.op3_language_id,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_weak_quality": weak_quality.op5_weak_quality,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_sentencepiece": sentencepieces.op7_sentencepiece,
    "op8_sharding": sharding.op8_sharding,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_centroid_clustering": centroid_clustering.op11_centroid_clustering,
    "op12_collocations": collocations.op12_collocations,
    "op13_secret_scan": secret_scan.op13_secret_scan,
}
ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op4_jaccard_join": jaccard_join.OP4_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op11_centroid_clustering": centroid_clustering.OP11_SQL,
    "op12_collocations": collocations.OP12_SQL,
}
