"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import compression_classifier, exact_dedup, html_extract, mixing, near_dedup, quality_rules, secret_scan, sentence_pieces, token_counts, url_filter

QUERIES = {
    "op1_sentence_pieces": sentence_pieces.op1_sentence_pieces,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_html_extract": html_extract.op3_html_extract,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_compression_classifier": compression_classifier.op8_compression_classifier,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}
ORACLE_SQL = {
    "op4_exact_dedup": exact_dedup.ORACLE_SQL,
    "op5_near_dedup": near_dedup.ORACLE_SQL,
    "op7_url_filter": url_filter.ORACLE_SQL,
}
