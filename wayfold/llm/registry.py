"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import (
    bestfit_packing, byte_bpe, exact_dedup, jaccard_join, license_scan, personal_data, quality_classifier, secret_scan, spelling_variants,
    substring_dedup, topk_search, toxicity, vector_codes,
)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_exact_top_k": topk_search.op8_exact_top_k,
    "op9_best_fit_packing": bestfit_packing.op9_best_fit_packing,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
    "op11_spelling_variants": spelling_variants.op11_spelling_variants,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_personal_data": personal_data.op13_personal_data,
}

ORACLES = {
    "op1_substring_dedup": substring_dedup.ORACLE_SQL,
    "op2_license_scan": license_scan.ORACLE_SQL,
    "op3_jaccard_join": jaccard_join.ORACLE_SQL,
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op8_exact_top_k": topk_search.ORACLE_SQL,
    "op11_spelling_variants": spelling_variants.ORACLE_SQL,
    "op12_vector_codes": vector_codes.ORACLE_SQL,
}
