"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import exact_dedup, line_dedup, lm_score, mixing, near_dup, quality_model, quality_rules, secret_scan, sentencepiece_fst, url_filter
from gridloom.llm.common import load


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": lambda s, d: line_dedup.digest(load(s, d, "documents"), shortest=line_dedup.QUERY_SHORTEST),
        "op2_near_dup": lambda s, d: near_dup.digest(load(s, d, "documents")),
        "op3_quality_rules": lambda s, d: quality_rules.digest(load(s, d, "documents"), load(s, d, "labels")),
        "op4_secret_scan": lambda s, d: secret_scan.digest(load(s, d, "documents")),
        "op5_mix_sources": lambda s, d: mixing.digest(load(s, d, "documents")),
        "op6_sentencepiece": lambda s, d: sentencepiece_fst.digest(load(s, d, "documents")),
        "op7_url_filter": lambda s, d: url_filter.digest(load(s, d, "pages")),
        "op8_exact_dedup": lambda s, d: exact_dedup.digest(load(s, d, "documents")),
        "op9_lm_score": lambda s, d: lm_score.digest(load(s, d, "documents")),
        "op10_quality_classifier": lambda s, d: quality_model.digest(load(s, d, "documents"), load(s, d, "labels")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_mix_sources": mixing.ORACLE, "op7_url_filter": url_filter.ORACLE, "op8_exact_dedup": exact_dedup.ORACLE}
