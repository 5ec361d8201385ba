"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from . import bpe, embedding_dedup, exact_dedup, language, licenses, near_dedup, oracles, packing, pii, quality, substring_dedup

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_language": language.op2_language,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_packing": packing.op4_packing,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_bpe": bpe.op6_bpe,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op9_licenses": licenses.op9_licenses,
    "op10_pii": pii.op10_pii,
}

ORACLES = {
    "op3_near_dedup": oracles.OP3_SQL,
    "op5_substring_dedup": oracles.OP5_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op8_embedding_dedup": oracles.OP8_SQL,
    "op9_licenses": licenses.OP9_SQL,
}
