"""Queries of the text operators: each over its whole tables, with production parameters."""

from __future__ import annotations

from tidemark.llm import alignment, ann, bpe, contamination, interactions, langid, licenses, lines, neardup, pii, quality, tokens, toxicity

QUERIES = {
    "op1_line_dedup": lines.op1,
    "op2_token_counts": tokens.op2,
    "op3_decontamination": contamination.op3,
    "op4_pii_pseudonyms": pii.op4,
    "op5_ann": ann.op5,
    "op6_near_dedup": neardup.op6,
    "op7_license_scan": licenses.op7,
    "op8_toxicity": toxicity.op8,
    "op9_quality_classifier": quality.op9,
    "op10_byte_bpe": bpe.op10,
    "op11_language_id": langid.op11,
    "op12_filter_interactions": interactions.op12,
    "op13_token_alignment": alignment.op13,
}
#: What is plain SQL; the rest is held against brute force in tests/llm.
ORACLE: dict[str, str] = {"op3_decontamination": contamination.SQL, "op12_filter_interactions": interactions.SQL}
