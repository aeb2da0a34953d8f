"""The queries of this subpackage, one for each operator, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from lakesift.llm import chat, decontamination, html_extract, license_scan, line_dedup, mixing, ngram_join, quality_rules, toxicity, url_filters

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_html_extract": html_extract.op4_html_extract,
    "op5_url_filters": url_filters.op5_url_filters,
    "op6_mixing": mixing.op6_mixing,
    "op7_chat_format": chat.op7_chat_format,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

ORACLES = {
    "op1_decontamination": decontamination.ORACLE,
    "op3_ngram_join": ngram_join.ORACLE,
    "op5_url_filters": url_filters.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op8_quality_rules": quality_rules.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
}
