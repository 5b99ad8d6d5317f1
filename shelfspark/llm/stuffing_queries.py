"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.stuffing import page_measures, spam_pages
from shelfspark.sources.tables import spread, table


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are for the most part repeated keywords, links or tags."""
    return spam_pages(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text").select(F.col("page_id").alias("doc_id"))


def p8_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What p8_found decides by, for every document."""
    shares = ("loose_share", "stuffed_share", "repeated_share")
    return page_measures(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text").withColumnRenamed("page_id", "doc_id").withColumns({c: F.round(c, 6) for c in shares})


QUERIES = {"p8_found": p8_found, "p8_measures": p8_measures}
ORACLES: dict[str, str] = {}
