"""The registered queries of the core library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paragrid.plans import context, corpus, events, evidence, facts, measures, reports, search, sources, texts, work

Query = Callable[[SparkSession, str], DataFrame]
_PLANS = (texts, facts, search, context, corpus, measures, reports, work, evidence, events, sources)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Lexical search, fused with its re-ranking, with at most two answers of a source."""
    return search.document_diverse(spark, folder)


def queries() -> dict[str, Query]:
    return {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _PLANS for name, sql in plan.SQL.items()}
