"""The queries of this subpackage and, where SQL can say them, their oracles."""

from __future__ import annotations

from markloom.llm import chat, decontamination, fingerprints, html, lexical, licenses, lm_scoring, ngram_join, quality, repair, secrets, sentencepiece, simhash

QUERIES = {
    "op1_lm_scoring": lm_scoring.op1_lm_scoring,
    "op2_sentencepiece": sentencepiece.op2_sentencepiece,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_license_scans": licenses.op4_license_scans,
    "op5_benchmark_decontamination": decontamination.op5_benchmark_decontamination,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_html_extraction": html.op7_html_extraction,
    "op8_document_fingerprints": fingerprints.op8_document_fingerprints,
    "op9_secret_scans": secrets.op9_secret_scans,
    "op10_ngram_jaccard_join": ngram_join.op10_ngram_jaccard_join,
    "op11_structure_repair": repair.op11_structure_repair,
    "op12_ranked_search": lexical.op12_ranked_search,
    "op13_simhash_near_dedup": simhash.op13_simhash_near_dedup,
}

ORACLE_SQL = {
    "op3_chat_formatting": chat.OP3_SQL,
    "op5_benchmark_decontamination": decontamination.OP5_SQL,
    "op11_structure_repair": repair.OP11_SQL,
    "op12_ranked_search": lexical.OP12_SQL,
}
