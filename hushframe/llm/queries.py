"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, chat, decontaminate, lm, neardup, pii, quality, sharding, substring, topk

QUERIES = {
    "op1_shards": sharding.op1_shards,
    "op2_jaccard": neardup.op2_jaccard,
    "op3_lm": lm.op3_lm,
    "op4_bpe": bpe.op4_bpe,
    "op5_quality": quality.op5_quality,
    "op6_surrogates": pii.op6_surrogates,
    "op7_topk": topk.op7_topk,
    "op8_contamination": decontaminate.op8_contamination,
    "op9_chat": chat.op9_chat,
    "op10_substrings": substring.op10_substrings,
}

ORACLES = {
    "op2_jaccard": neardup.OP2_SQL,
    "op7_topk": topk.OP7_SQL,
    "op8_contamination": decontaminate.OP8_SQL,
    "op9_chat": chat.OP9_SQL,
    "op10_substrings": substring.OP10_SQL,
}
