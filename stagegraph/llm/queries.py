"""The operators' queries and their SQL, for the entry point."""

from __future__ import annotations

from stagegraph.llm import bpe, decontamination, html_extraction, line_dedup, simhash, substring_dedup, suffix_dedup, topk_search, toxicity, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_html_extraction": html_extraction.op3_html_extraction,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_topk_search": topk_search.op7_topk_search,
    "op8_warc": warc.op8_warc,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

ORACLE_SQL = {
    "op4_suffix_dedup": suffix_dedup.OP4_SQL,
    "op5_substring_dedup": substring_dedup.OP5_SQL,
    "op7_topk_search": topk_search.OP7_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
}
