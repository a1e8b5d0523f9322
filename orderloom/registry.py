"""Queries of the core package and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderloom.plans import answer_queries, base, build_queries, cache_queries, catalog_queries, detail_queries, dialogue_queries, hybrid_queries, metric_queries, refresh_queries  # noqa: F401  they register their queries


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batched retrieval with graph expansion and rerank."""
    return base.QUERIES["graph_retrieval"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
