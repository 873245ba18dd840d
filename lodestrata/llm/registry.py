"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import ann, chat, exact_topk, jaccard_join, merkle, mixing, ngram_lm, phrases, pieces, secret_scan, sharding, token_files, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_sentence_pieces": pieces.op3_sentence_pieces,
        "op4_token_files": token_files.op4_token_files,
        "op5_chat_format": chat.op5_chat_format,
        "op6_kd_shards": sharding.op6_kd_shards,
        "op7_jaccard_join": jaccard_join.op7_jaccard_join,
        "op8_nearest": ann.op8_nearest,
        "op10_ngram_lm": ngram_lm.op10_ngram_lm,
        "op9_exact_topk": exact_topk.op9_exact_topk,
        "op11_phrases": phrases.op11_phrases,
        "op12_secret_scan": secret_scan.op12_secret_scan,
        "op13_merkle_manifest": merkle.op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": mixing.OP1_SQL,
        "op9_exact_topk": exact_topk.OP9_SQL,
        "op11_phrases": phrases.OP11_SQL,
        "op12_secret_scan": secret_scan.OP12_SQL,
        "op13_merkle_manifest": merkle.OP13_SQL,
    }
