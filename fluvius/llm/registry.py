"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from . import align, attention_lm, decontaminate, exact_dedup, jaccard_join, line_dedup, merkle, mixing, pii, quality, suffix_dedup, token_counts, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_token_counts": token_counts.query,
    "op3_line_dedup": line_dedup.query,
    "op4_warc": warc.query,
    "op5_suffix_dedup": suffix_dedup.query,
    "op6_mixing": mixing.query,
    "op7_decontaminate": decontaminate.query,
    "op8_pii": pii.query,
    "op9_jaccard_join": jaccard_join.query,
    "op10_quality": quality.query,
    "op11_token_alignment": align.query,
    "op12_merkle_manifest": merkle.query,
    "op13_attention_lm": attention_lm.query,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op4_warc": warc.SQL,
    "op6_mixing": mixing.SQL,
    "op12_merkle_manifest": merkle.SQL,
}
