"""Registered queries of this folder."""

from __future__ import annotations

from sparktap.llm import chat_format, exact_dedup, filter_audit, html_extract, language_id, media_match, merkle, near_dedup, ngram_join, packing, piece_bpe, secret_scan, toxicity

QUERIES = {
    "op1_media_match": media_match.op1_media_match,
    "op8_html_extract": html_extract.op8_html_extract,
    "op6_sentencepiece": piece_bpe.op6_sentencepiece,
    "op5_language_id": language_id.op5_language_id,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op7_packing": packing.op7_packing,
    "op10_chat_format": chat_format.op10_chat_format,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_ngram_jaccard": ngram_join.op12_ngram_jaccard,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
ORACLE = {
    "op3_secret_scan": secret_scan.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op9_near_dedup": near_dedup.SQL,
    "op10_chat_format": chat_format.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_ngram_jaccard": ngram_join.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
