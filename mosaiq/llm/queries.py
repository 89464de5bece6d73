"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, licenses, lines, ngrams, pieces, quality, sharding, tokens, toxicity, urls


def queries() -> dict:
    return {
        "op1_ngram_join": ngrams.query,
        "op2_license_scan": licenses.query,
        "op3_decontaminate": decontaminate.query,
        "op4_quality_rules": quality.query,
        "op5_token_counts": tokens.query,
        "op6_line_dedup": lines.query,
        "op7_pieces": pieces.query,
        "op8_sharding": sharding.query,
        "op9_url_filters": urls.query,
        "op10_toxicity": toxicity.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": ngrams.ORACLE,
        "op2_license_scan": licenses.ORACLE,
        "op3_decontaminate": decontaminate.ORACLE,
        "op4_quality_rules": quality.ORACLE,
        "op6_line_dedup": lines.ORACLE,
        "op8_sharding": sharding.ORACLE,
        "op9_url_filters": urls.ORACLE,
    }
