"""All queries of the panel engine, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.plans import diagnostic_queries, feature_queries, matrix_queries, portfolio_queries, section_queries, storage_queries
from marlstone.session import prepare

_MODULES = (feature_queries, section_queries, portfolio_queries, diagnostic_queries, matrix_queries, storage_queries)
Query = Callable[[SparkSession, str], DataFrame]


def _prepared(query: Query) -> Query:
    return lambda spark, sf_dir: query(prepare(spark), sf_dir)


def queries() -> dict[str, Query]:
    return {name: _prepared(q) for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
