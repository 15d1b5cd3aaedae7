"""The text operators' queries and their SQL."""

from __future__ import annotations

from mesolite.llm import bm25_search, chat_format, decontamination, hard_negatives, jaccard_join, language_id, lm_score, mixing, pii, secret_scan, substring_dedup, virtual_slots, weighted_clustering

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_pii": pii.op3_pii,
    "op4_mixing": mixing.op4_mixing,
    "op5_bm25_search": bm25_search.op5_bm25_search,
    "op6_lm_score": lm_score.op6_lm_score,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_weighted_clustering": weighted_clustering.op12_weighted_clustering,
    "op13_virtual_slots": virtual_slots.op13_virtual_slots,
}

ORACLE_SQL = {
    "op5_bm25_search": bm25_search.ORACLE_SQL,
    "op8_chat_format": chat_format.ORACLE_SQL,
    "op9_decontamination": decontamination.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    "op12_weighted_clustering": weighted_clustering.ORACLE_SQL,
}
