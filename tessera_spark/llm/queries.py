"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontam, jaccard, licences, line_dedup, mixing, quality, secrets, tokens, toxicity

QUERIES = {
    "op1_decontamination": decontam.op1_decontamination,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality": quality.op3_quality,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_secrets": secrets.op5_secrets,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_chat_format": chat.op8_chat_format,
    "op9_token_counts": tokens.op9_token_counts,
    "op10_licences": licences.op10_licences,
}

SQL = {
    "op3_quality": quality.OP3_SQL,
    "op8_chat_format": chat.OP8_SQL,
}
