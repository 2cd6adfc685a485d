"""Queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from tessera.llm import decontam, html_extract, kn_quality, langid, ngram_join, quality_rules, secrets, sentencepiece_viterbi, token_counts, warc

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_secret_scans": secrets.op2_secret_scans,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_quality_classifier": kn_quality.op4_quality_classifier,
    "op5_warc": warc.op5_warc,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_html_extraction": html_extract.op7_html_extraction,
    "op8_sentencepiece": sentencepiece_viterbi.op8_sentencepiece,
    "op9_language_id": langid.op9_language_id,
    "op10_ngram_join": ngram_join.op10_ngram_join,
}

ORACLE = {
    "op2_secret_scans": secrets.ORACLE_SQL,
    "op3_decontamination": decontam.ORACLE_SQL,
    "op5_warc": warc.ORACLE_SQL,
    "op6_quality_rules": quality_rules.ORACLE_SQL,
    "op10_ngram_join": ngram_join.ORACLE_SQL,
}
