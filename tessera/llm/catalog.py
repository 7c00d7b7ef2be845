"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import mixing, passages, pieces, pii, quality, secrets, simhash, sketches, tokens, urls


def queries() -> dict:
    return {
        "op1_sentencepiece": pieces.op1_sentencepiece,
        "op2_mix_sources": mixing.op2_mix_sources,
        "op3_repeated_passages": passages.op3_repeated_passages,
        "op4_url_filter": urls.op4_url_filter,
        "op9_quality_cascade": quality.op9_quality_cascade,
        "op5_surrogates": pii.op5_surrogates,
        "op6_fingerprints": sketches.op6_fingerprints,
        "op7_token_counts": tokens.op7_token_counts,
        "op8_simhash": simhash.op8_simhash,
        "op10_secret_scan": secrets.op10_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mix_sources": mixing.ORACLE,
        "op4_url_filter": urls.ORACLE,
        "op6_fingerprints": sketches.ORACLE,
        "op9_quality_cascade": quality.ORACLE,
    }
