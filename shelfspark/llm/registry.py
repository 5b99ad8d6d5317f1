"""All queries of the subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import history_queries, leakage_queries, mixing_queries, neighbour_queries, percentile_queries, splitting_queries, stuffing_queries

_MODULES = [history_queries, splitting_queries, percentile_queries, mixing_queries, leakage_queries, neighbour_queries, stuffing_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
