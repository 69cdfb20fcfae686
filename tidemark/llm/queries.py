"""The operators' registered queries and their SQL."""

from __future__ import annotations

from . import bpe, decontaminate, fingerprint, html_extract, lm_score, neardup, pii, quality, sharding, url_filter

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_bpe": bpe.op2_bpe,
    "op3_sharding": sharding.op3_sharding,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_html_text": html_extract.op5_html_text,
    "op6_pii": pii.op6_pii,
    "op7_fingerprints": fingerprint.op7_fingerprints,
    "op8_simhash_neardup": neardup.op8_simhash_neardup,
    "op9_lm_score": lm_score.op9_lm_score,
    "op10_url_filters": url_filter.op10_url_filters,
}
ORACLES = {"op3_sharding": sharding.SQL, "op4_decontamination": decontaminate.SQL, "op10_url_filters": url_filter.SQL}
