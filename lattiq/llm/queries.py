"""The named queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import decontam, html_text, jaccard, license_scan, packing, pii, quality, secret_scan, suffix_dedup, token_order

QUERIES = {
    "op1_training_order": token_order.query,
    "op2_best_fit_packing": packing.query,
    "op3_license_fuzzy": license_scan.query,
    "op4_secret_trigrams": secret_scan.query,
    "op5_suffix_columns": suffix_dedup.query,
    "op6_pii_boosted": pii.query,
    "op7_decontamination_index": decontam.query,
    "op8_quality_mcd": quality.query,
    "op9_html_line_blocks": html_text.query,
    "op10_ngram_jaccard_join": jaccard.query,
}
ORACLES: dict[str, str] = {
    "op4_secret_trigrams": secret_scan.ORACLE,
    "op5_suffix_columns": suffix_dedup.ORACLE,
    "op7_decontamination_index": decontam.ORACLE,
    "op10_ngram_jaccard_join": jaccard.ORACLE,
}
