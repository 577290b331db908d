"""The subpackage's queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from corvane.llm import bpe, exact_dedup, filter_audit, html_extract, line_dedup, mixing, quality, secrets, simhash, substring_dedup, topk, toxicity, vector_codes

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_topk": topk.op2_topk,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_html": html_extract.op6_html,
    "op7_bpe": bpe.op7_bpe,
    "op8_simhash": simhash.op8_simhash,
    "op9_secrets": secrets.op9_secrets,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
ORACLE_SQL = {
    "op2_topk": topk.OP2_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op11_line_dedup": line_dedup.OP11_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
