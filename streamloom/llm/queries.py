"""Queries of the training-data operators: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from streamloom.llm import bpe, chat, jaccard, langid, matroska, mixing, packing, quality, topk, urls

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_packing": packing.op2_packing,
    "op3_chat": chat.op3_chat,
    "op4_matroska": matroska.op4_matroska,
    "op5_url_filter": urls.op5_url_filter,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_quality": quality.op7_quality,
    "op8_topk": topk.op8_topk,
    "op9_langid": langid.op9_langid,
    "op10_mixing": mixing.op10_mixing,
}
ORACLES = {"op3_chat": chat.OP3_SQL, "op5_url_filter": urls.OP5_SQL, "op6_jaccard": jaccard.OP6_SQL, "op8_topk": topk.OP8_SQL}
