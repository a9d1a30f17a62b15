"""Queries of this subpackage, one per operator, over whole tables; SQL where it can express one."""

from __future__ import annotations

from . import bpe, chat, jaccard_join, line_dedup, media, packing, quality, token_counts, token_store, topk

QUERIES = {
    "op1_media_columns": media.query,
    "op2_token_counts": token_counts.query,
    "op3_chat_formatting": chat.query,
    "op4_byte_bpe": bpe.query,
    "op5_token_store": token_store.query,
    "op6_ngram_jaccard_join": jaccard_join.query,
    "op7_quality_knn": quality.query,
    "op8_best_fit_packing": packing.query,
    "op9_line_dedup": line_dedup.query,
    "op10_top_k": topk.query,
}
ORACLE_SQL = {"op9_line_dedup": line_dedup.ORACLE, "op10_top_k": topk.ORACLE}
