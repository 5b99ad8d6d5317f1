"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.mixing import budgets, histogram, selection, shares, sized, thresholds
from shelfspark.sources.tables import spread, table


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sized(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")), "doc_id", "text", "source")


def _planned(spark: SparkSession, sf_dir: str, sizes: DataFrame) -> DataFrame:
    buckets = histogram(sizes)
    return thresholds(budgets(table(spark, sf_dir, "mix_targets"), buckets), sizes, buckets)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets whose source cannot reach its share."""
    sizes = _sized(spark, sf_dir)
    return shares(_planned(spark, sf_dir, sizes), sizes).where("short").select("mix_id", "source")


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of every mix."""
    sizes = _sized(spark, sf_dir)
    return selection(_planned(spark, sf_dir, sizes), sizes)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares of every mix."""
    sizes = _sized(spark, sf_dir)
    return shares(_planned(spark, sf_dir, sizes), sizes).withColumn("reached_share", F.round("reached_share", 6))


QUERIES = {"p7_found": p7_found, "p7_selection": p7_selection, "p7_shares": p7_shares}
#: By bytes instead of tokens: whether a source reaches its share does not hang on the measure in these tables.
ORACLES = {
    "p7_found": r"""with sized as (
  select nullif(regexp_replace(regexp_replace(lower(source), '[\s\p{Z}_\-./]+', '_', 'g'), '^_+|_+$', '', 'g'), '') as source, coalesce(strlen(text), 0) as size from documents
), of_source as (select source, sum(size) as size from sized group by 1)
select t.mix_id, t.source from mix_targets t left join of_source s on s.source = t.source
where coalesce(t.target_share, 0) * coalesce(t.budget_ratio, 0) * (select sum(size) from sized) > coalesce(t.max_repeats, 0) * coalesce(s.size, 0)""",
}
