"""Registry of the evidence-retrieval queries: name, Spark callable and DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import engine_plans, guard_plans, intent_plans, planning_plans, rowset_plans, text_plans, url_plans

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (url_plans, intent_plans, text_plans, rowset_plans, guard_plans, planning_plans, engine_plans)


def _plans() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {}
    for module in _MODULES:
        out.update(module.PLANS)
    return out


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _plans().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _plans().items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["rnk_03_rerank_top"](spark, sf_dir)
