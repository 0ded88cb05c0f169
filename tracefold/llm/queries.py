"""Registered queries of this folder and their SQL."""

from __future__ import annotations

from tracefold.llm import (
    op1_minhash, op2_quality_rules, op3_sharding, op4_sentencepiece, op5_toxicity, op6_packing, op7_token_counts, op8_quality_classifier, op9_chat,
    op10_exact_dedup, op11_clustering, op12_filter_audit, op13_decontamination,
)

MODULES = [
    op1_minhash, op2_quality_rules, op3_sharding, op4_sentencepiece, op5_toxicity, op6_packing, op7_token_counts, op8_quality_classifier, op9_chat,
    op10_exact_dedup, op11_clustering, op12_filter_audit, op13_decontamination,
]
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
