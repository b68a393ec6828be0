"""The registered queries of this package and their DuckDB texts."""

from __future__ import annotations

from arbor.llm import (bpe, chat_format, curve_neighbours, exact_dedup, hard_negatives, license_scan, line_dedup, merkle, minhash_dedup,
                       mixing, quality_rules, token_counts, toxicity)
from arbor.llm.oracle import ORACLE

__all__ = ["QUERIES", "ORACLE"]

QUERIES = {f.__name__: f for f in (
    toxicity.op1_toxicity, quality_rules.op2_quality_rules, chat_format.op3_chat_format,
    license_scan.op4_license_scan, mixing.op5_mixing, exact_dedup.op6_exact_dedup,
    minhash_dedup.op7_minhash_dedup, token_counts.op8_token_counts, bpe.op9_bpe, line_dedup.op10_line_dedup,
    hard_negatives.op11_hard_negatives, merkle.op12_merkle, curve_neighbours.op13_curve_neighbours)}
