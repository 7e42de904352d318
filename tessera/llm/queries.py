"""Queries of this subpackage: one opN_<name> for each operator, and the SQL that some can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bagminhash, bwt_dedup, chat_repair, context_mixing, decontaminate, hard_negatives, language_id, merkle, pii, piece_sampling, syncmers, toxicity, warc_derive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_repair": chat_repair.query,
    "op2_syncmers": syncmers.query,
    "op3_decontaminate": decontaminate.query,
    "op4_toxicity": toxicity.query,
    "op5_pii": pii.query,
    "op6_bwt_dedup": bwt_dedup.query,
    "op7_warc_derive": warc_derive.query,
    "op8_bagminhash": bagminhash.query,
    "op9_context_mixing": context_mixing.query,
    "op10_piece_sampling": piece_sampling.query,
    "op11_language_id": language_id.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_merkle": merkle.query,
}

SQL: dict[str, str] = {"op3_decontaminate": decontaminate.SQL, "op7_warc_derive": warc_derive.SQL, "op12_hard_negatives": hard_negatives.SQL, "op13_merkle": merkle.SQL}
