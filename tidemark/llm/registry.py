"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, lm, mixing, pii, quality, simhash, substrings, suffixes, toxicity, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_vectors": vectors.op1_vectors,
        "op2_mixing": mixing.op2_mixing,
        "op3_suffixes": suffixes.op3_suffixes,
        "op4_simhash": simhash.op4_simhash,
        "op5_quality": quality.op5_quality,
        "op6_substrings": substrings.op6_substrings,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_lm": lm.op9_lm,
        "op10_pii": pii.op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_vectors": vectors.OP1_SQL, "op3_suffixes": suffixes.OP3_SQL, "op7_decontaminate": decontaminate.OP7_SQL}
