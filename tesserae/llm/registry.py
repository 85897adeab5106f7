"""The training-data queries, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, embeddings, exact_dedup, html, jaccard, lm, mixing, pii, quality

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_mix": mixing.op2_mix,
    "op3_quality": quality.op3_quality,
    "op4_html_text": html.op4_html_text,
    "op5_embedding_dedup": embeddings.op5_embedding_dedup,
    "op6_bpe": bpe.op6_bpe,
    "op7_pii_surrogates": pii.op7_pii_surrogates,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_lm_score": lm.op9_lm_score,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
}

ORACLE_SQL = {
    "op1_chat_format": chat.OP1_SQL,
    "op5_embedding_dedup": embeddings.OP5_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
}
