"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.percentiles import merged, percentiles, sketches
from shelfspark.sources.tables import table

KEYS = ["provider_key", "execution_mode"]
SHARES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ingest_samples").where("elapsed_ms >= 1")


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per provider and mode: count, median, 90th, 95th, 99th percentile of elapsed_ms and the bound of their rank error."""
    built = sketches(_samples(spark, sf_dir), {"provider_key": F.col("provider_key"), "execution_mode": F.lower("execution_mode")}, F.col("elapsed_ms"))
    return percentiles(built, KEYS, SHARES)


def p4_daily_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sketch per day, provider and mode, to be stored and combined later."""
    day = F.to_date(F.timestamp_millis("sampled_at_ms"))
    return sketches(_samples(spark, sf_dir), {"day": day, "provider_key": F.col("provider_key"), "execution_mode": F.lower("execution_mode")}, F.col("elapsed_ms"))


def p4_from_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same percentiles as p4_percentiles, from the sketches of the days."""
    return percentiles(merged(p4_daily_sketches(spark, sf_dir), KEYS), KEYS, SHARES)


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, least and largest value that each group's sketch covers."""
    built = sketches(_samples(spark, sf_dir), {"provider_key": F.col("provider_key"), "execution_mode": F.lower("execution_mode")}, F.col("elapsed_ms"))
    return built.select(*KEYS, F.col("count").alias("samples"), F.col("low").cast("long").alias("least_ms"), F.col("high").cast("long").alias("most_ms"))


QUERIES = {"p4_percentiles": p4_percentiles, "p4_daily_sketches": p4_daily_sketches, "p4_from_days": p4_from_days, "p4_counts": p4_counts}

ORACLES = {
    "p4_counts": """
select provider_key, lower(execution_mode) as execution_mode, count(*) as samples, min(elapsed_ms) as least_ms, max(elapsed_ms) as most_ms
from ingest_samples where elapsed_ms >= 1 group by 1, 2""",
}
