"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, chat, decontaminate, jaccard, licenses, neighbours, quality, secrets, substrings, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_licenses": licenses.op3_licenses,
        "op4_jaccard": jaccard.op4_jaccard,
        "op5_substrings": substrings.op5_substrings,
        "op6_bpe": bpe.op6_bpe,
        "op7_chat": chat.op7_chat,
        "op8_neighbours": neighbours.op8_neighbours,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_secrets": secrets.op10_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_chat": chat.OP7_SQL}
