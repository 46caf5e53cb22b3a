"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from lumenframe.llm import bpe, decontamination, hard_negatives, jaccard_join, language_model, line_dedup, media_columns, oracles, quality, sharding, suffix_dedup, urls, vector_codes, warc


def queries() -> dict:
    found = [language_model.op1_language_model, suffix_dedup.op2_suffix_dedup, quality.op3_quality_rules, urls.op4_url_filters, line_dedup.op5_line_dedup, bpe.op6_bpe, sharding.op7_sharding, jaccard_join.op8_jaccard_join, decontamination.op9_decontamination, warc.op10_warc, vector_codes.op11_vector_codes, hard_negatives.op12_hard_negatives, media_columns.op13_media_columns]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
