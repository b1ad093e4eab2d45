"""The queries of the training-data operators, each over its whole table, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import arc_to_warc, decontaminate_bm25, html_mincut, language_zstd, line_quality, line_winnowing, mixing_entropy, pii_surrogates, simhash_bitsliced, url_boosting
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate_bm25.op9_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {
        "op1_arc_to_warc": _over("pages", arc_to_warc.op1_arc_to_warc),
        "op2_language_id": _over("documents", language_zstd.op2_language_id),
        "op3_pii_surrogates": _over("documents", pii_surrogates.op3_pii_surrogates),
        "op4_line_dedup": _over("documents", line_winnowing.op4_line_dedup),
        "op5_quality_rules": _over("documents", line_quality.op5_quality_rules),
        "op6_source_mixing": _over("documents", mixing_entropy.op6_source_mixing),
        "op7_url_filter": _over("pages", url_boosting.op7_url_filter),
        "op8_simhash_near_dedup": _over("documents", simhash_bitsliced.op8_simhash_near_dedup),
        "op9_decontamination": _op9,
        "op10_html_extraction": _over("pages", html_mincut.op10_html_extraction),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_arc_to_warc": arc_to_warc.OP1_SQL,
        "op4_line_dedup": line_winnowing.OP4_SQL,
    }
