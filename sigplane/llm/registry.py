"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sigplane.llm import bpe, fingerprint, html, jaccard, lines, packing, pii, quality, rules, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprint": fingerprint.op1_fingerprint,
        "op2_line_dedup": lines.op2_line_dedup,
        "op3_quality": quality.op3_quality,
        "op4_jaccard": jaccard.op4_jaccard,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_rules": rules.op6_rules,
        "op7_packing": packing.op7_packing,
        "op8_html": html.op8_html,
        "op9_bpe": bpe.op9_bpe,
        "op10_pii": pii.op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_rules": rules.OP6_SQL,
    }
