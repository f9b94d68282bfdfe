"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, conversations, embedding_dedup, licences, line_dedup, lm_scoring, merkle, minhash_dedup, mixing, pii, quality, rules, topk_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_licence_scan": licences.op2_licence_scan,
        "op3_byte_bpe": byte_bpe.op3_byte_bpe,
        "op4_topk_search": topk_search.op4_topk_search,
        "op5_minhash_dedup": minhash_dedup.op5_minhash_dedup,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_lm_scoring": lm_scoring.op7_lm_scoring,
        "op8_pii": pii.op8_pii,
        "op9_mixing": mixing.op9_mixing,
        "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_conversation_repair": conversations.op12_conversation_repair,
        "op13_quality_rules": rules.op13_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_topk_search": topk_search.OP4_SQL,
        "op10_embedding_dedup": embedding_dedup.OP10_SQL,
        "op11_merkle_manifest": merkle.OP11_SQL,
    }
