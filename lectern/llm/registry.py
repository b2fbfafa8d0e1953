"""Queries of this subpackage, by name, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import cross_tokens, decontaminate, exact_dedup, fill_middle, html_extract, langid, mixing, near_dedup, pii, substring_dedup, token_counts, token_output, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_language_id": langid.op4_language_id,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_html_extract": html_extract.op6_html_extract,
    "op7_pii": pii.op7_pii,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_token_output": token_output.op10_token_output,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_url_filters": url_filters.op12_url_filters,
    "op13_cross_tokens": cross_tokens.op13_cross_tokens,
}
SQL: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op8_near_dedup": near_dedup.OP8_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
    "op11_fill_middle": fill_middle.OP11_SQL,
    "op12_url_filters": url_filters.OP12_SQL,
}
