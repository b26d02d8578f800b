"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, chat, decontaminate, lmscore, minhash, secrets, suffixes, tokencounts, toxicity, vectors


def queries() -> dict:
    found = (
        minhash.op1_minhash_near_dedup, chat.op2_chat_formatting, decontaminate.op3_decontamination, lmscore.op4_lm_scoring, vectors.op5_embedding_near_dedup,
        tokencounts.op6_token_counts, secrets.op7_secret_scans, toxicity.op8_toxicity, suffixes.op9_suffix_dedup, bpe.op10_bpe,
    )
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": chat.ORACLE} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
