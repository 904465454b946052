"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from . import ann, decontamination, html_text, language_id, mixing, near_dedup, sharding, token_counts, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_ann": ann.op1_ann,
        "op2_language_id": language_id.op2_language_id,
        "op3_near_dedup": near_dedup.op3_near_dedup,
        "op4_html_text": html_text.op4_html_text,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_decontamination": decontamination.op6_decontamination,
        "op7_sharding": sharding.op7_sharding,
        "op8_mixing": mixing.op8_mixing,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_token_counts": token_counts.op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_near_dedup": near_dedup.SQL_NEAR_DEDUP,
        "op5_url_filter": url_filter.SQL_URL_FILTER,
        "op6_decontamination": decontamination.SQL_DECONTAMINATION,
        "op7_sharding": sharding.SQL_SHARDING,
        "op8_mixing": mixing.SQL_MIXING,
    }
