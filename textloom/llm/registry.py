"""Queries over the driver's tables: one ``opN_<name>`` for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from textloom.llm import byte_bpe, language_id, line_dedup, mixing, near_dedup, order_minhash, repetition, secrets, suffix_dedup, toxicity
from textloom.llm.common import documents


def queries() -> dict:
    return {
        "op1_cube_mixing": lambda spark, sf: mixing.digest(documents(spark, sf)),
        "op2_line_dedup": lambda spark, sf: line_dedup.digest(documents(spark, sf)),
        "op3_secret_scan": lambda spark, sf: secrets.digest(documents(spark, sf)),
        "op4_byte_bpe": lambda spark, sf: byte_bpe.digest(documents(spark, sf)),
        "op5_language_id": lambda spark, sf: language_id.digest(documents(spark, sf)),
        "op6_repetition": lambda spark, sf: repetition.digest(documents(spark, sf)),
        "op7_lsh_forest": lambda spark, sf: near_dedup.digest(documents(spark, sf)),
        "op8_suffix_dedup": lambda spark, sf: suffix_dedup.digest(documents(spark, sf)),
        "op9_toxicity": lambda spark, sf: toxicity.digest(documents(spark, sf), documents(spark, sf, "labels")),
        "op10_order_minhash": lambda spark, sf: order_minhash.digest(documents(spark, sf)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.ORACLE}
