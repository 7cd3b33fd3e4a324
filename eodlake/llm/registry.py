"""Queries over the test tables, one per operator, and their SQL."""

from __future__ import annotations

from eodlake.llm import audit, collocation, decontaminate, fingerprint, licenses, mixing, quality, simhash, suffix_dedup, tokens, toxicity, url_filter, wavelet

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_simhash": simhash.op2_simhash,
    "op3_url_filters": url_filter.op3_url_filters,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_token_counts": tokens.op5_token_counts,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_quality": quality.op7_quality,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_mixing": mixing.op9_mixing,
    "op10_fingerprints": fingerprint.op10_fingerprints,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_collocations": collocation.op12_collocations,
    "op13_token_files": wavelet.op13_token_files,
}

SQL = {
    "op1_licenses": licenses.OP1_SQL,
    "op3_url_filters": url_filter.OP3_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op11_filter_audit": audit.OP11_SQL,
    "op12_collocations": collocation.OP12_SQL,
}
