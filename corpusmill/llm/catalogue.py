"""Queries of this subpackage and the SQL that states their results, where SQL can."""

from __future__ import annotations

from . import archives, byte_bpe, divergence, fingerprints, line_dedup, near_dedup, packing, quality, sharding, token_counts, token_files, toxicity, whitening

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_byte_bpe": byte_bpe.op4_byte_bpe,
    "op5_packing": packing.op5_packing,
    "op6_token_files": token_files.op6_token_files,
    "op7_sharding": sharding.op7_sharding,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_archives": archives.op9_archives,
    "op10_quality": quality.op10_quality,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_whitening": whitening.op12_whitening,
    "op13_divergence": divergence.op13_divergence,
}

ORACLES: dict[str, str] = {"op1_line_dedup": line_dedup.ORACLE, "op9_archives": archives.ORACLE, "op10_quality": quality.ORACLE, "op13_divergence": divergence.ORACLE}
