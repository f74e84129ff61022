"""Queries over the given tables, one for each training-data operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import byte_bpe, curve_packing, decontamination, hard_negatives, hnsw, importance_resampling, language_id, line_dedup, merkle, minhash_forest, quality_rules, secret_scan, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hilbert_packing": curve_packing.op1_hilbert_packing,
    "op2_credential_links": secret_scan.op2_credential_links,
    "op3_importance_resampling": importance_resampling.op3_importance_resampling,
    "op4_line_labels": quality_rules.op4_line_labels,
    "op5_near_lines": line_dedup.op5_near_lines,
    "op6_zstd_languages": language_id.op6_zstd_languages,
    "op7_segment_tree_bpe": byte_bpe.op7_segment_tree_bpe,
    "op8_unigram_counts": token_counts.op8_unigram_counts,
    "op9_lsh_forest": minhash_forest.op9_lsh_forest,
    "op10_hnsw": hnsw.op10_hnsw,
    "op11_coordinate_pruning": hard_negatives.op11_coordinate_pruning,
    "op12_slot_pivot_merkle": merkle.op12_slot_pivot_merkle,
    "op13_positional_index": decontamination.op13_positional_index,
}

ORACLE_SQL: dict[str, str] = {
    "op5_near_lines": line_dedup.ORACLE,
    "op11_coordinate_pruning": hard_negatives.ORACLE,
    "op12_slot_pivot_merkle": merkle.oracle(),
    "op13_positional_index": decontamination.ORACLE,
}
