"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfspark.queries import assets, intervals, lookups, media, performance, retrieval, shapes, streams

_MODULES = [intervals, retrieval, lookups, assets, media, performance, shapes, streams]
FLAGSHIP = "q1_asset_search"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
