"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sweepgrid.llm import conversations, exact_dedup, lm, media, mixing, near, packing, pii, runs, substring, tokens, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op10_near_join": near.op10_near_join,
        "op11_conversation_repair": conversations.op11_conversation_repair,
        "op12_token_counts": tokens.op12_token_counts,
        "op13_periodic_runs": runs.op13_periodic_runs,
        "op1_substring_dedup": substring.op1_substring_dedup,
        "op2_media_columns": media.op2_media_columns,
        "op3_pii_boosted": pii.op3_pii_boosted,
        "op4_warc_bundles": warc.op4_warc_bundles,
        "op5_packing": packing.op5_packing,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_lm_interpolation": lm.op7_lm_interpolation,
        "op8_mixing": mixing.op8_mixing,
        "op9_toxicity": toxicity.op9_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_bundles": warc.ORACLE, "op6_exact_dedup": exact_dedup.ORACLE, "op8_mixing": mixing.ORACLE}
