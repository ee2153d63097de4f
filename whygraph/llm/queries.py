"""Registered corpus queries and the SQL that states the same results."""

from __future__ import annotations

from . import chat, decontaminate, exact_dedup, hard_negatives, html_extract, lm, mixing, ngram_join, pii, quality, suffix_dedup, warc, whitening

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_html_extraction": html_extract.op2_html_extraction,
    "op3_quality": quality.op3_quality,
    "op4_pii": pii.op4_pii,
    "op5_mixing": mixing.op5_mixing,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_warc": warc.op8_warc,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_lm_scoring": lm.op10_lm_scoring,
    "op11_whitening": whitening.op11_whitening,
    "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLE_SQL = {
    "op1_decontamination": decontaminate.OP1_SQL,
    "op6_ngram_join": ngram_join.OP6_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
    "op9_chat_formatting": chat.OP9_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
