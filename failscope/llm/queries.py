"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from failscope.llm import decontamination, exact_dedup, html_extract, line_dedup, mixing, near_dedup, personal_data, quality, token_counts, url_filter

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_html_extract": html_extract.op2_html_extract,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_mixing": mixing.op6_mixing,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_personal_data": personal_data.op8_personal_data,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

ORACLES = {
    "op3_near_dedup": near_dedup.ORACLE,
    "op4_url_filter": url_filter.ORACLE,
    "op5_decontamination": decontamination.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
}
