"""The queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talkweave.llm import q_chat, q_codes, q_divergence, q_license, q_packing, q_pieces, q_quality_mil, q_quality_rules, q_range_join, q_simhash, q_suffix, q_toxicity, q_url

PARTS = (q_packing, q_chat, q_codes, q_divergence, q_license, q_pieces, q_quality_mil, q_quality_rules, q_range_join, q_simhash, q_suffix, q_toxicity, q_url)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in PARTS for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in PARTS for k, s in getattr(m, "ORACLE", {}).items()}
