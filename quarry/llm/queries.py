"""Queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import ball_tree, licenses, lm_scoring, manifest, near_dups, packing, pieces, quality, sharding, spelling, suffix_dedup, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.query,
    "op2_lm_scoring": lm_scoring.query,
    "op3_quality_rules": quality.query,
    "op4_best_fit_packing": packing.query,
    "op5_near_duplicates": near_dups.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op7_piece_codec": pieces.query,
    "op8_exact_top_k": ball_tree.query,
    "op9_uniform_shards": sharding.query,
    "op10_token_counts": token_counts.query,
    "op11_merkle_manifest": manifest.query,
    "op12_spelling_variants": spelling.query,
    "op13_license_scans": licenses.query,
}

ORACLES: dict[str, str] = {"op8_exact_top_k": ball_tree.ORACLE, "op11_merkle_manifest": manifest.ORACLE, "op12_spelling_variants": spelling.ORACLE}
