"""The registered queries of the corpus operators, their SQL where it exists, and the pipeline's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, linededup, lm, media, mixing, quality, secrets, simhash, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
        "op2_chat_format": chat.op2_chat_format,
        "op3_mix_sources": mixing.op3_mix_sources,
        "op4_quality_network": quality.op4_quality_network,
        "op5_katz_backoff": lm.op5_katz_backoff,
        "op6_line_dedup": linededup.op6_line_dedup,
        "op7_toxicity_chain": toxicity.op7_toxicity_chain,
        "op8_progressive_jpeg": media.op8_progressive_jpeg,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_secret_scan": secrets.op10_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": linededup.OP6_SQL, "op9_decontaminate": decontaminate.OP9_SQL}
