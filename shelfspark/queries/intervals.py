"""Queries over continuous periods and gaps (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.intervals import intervals_of
from shelfspark.sources.tables import table
from shelfspark.streaming.keyed import streamed_periods_and_gaps


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods and gaps per ``video_key`` of chunk_segments and per ``asset_path`` of asset_hits, from the keyed state of a stream."""
    rows = intervals_of(
        table(spark, sf_dir, "chunk_segments"), "chunk_segments", "video_key", "start_seconds", "end_seconds"
    ).unionByName(intervals_of(table(spark, sf_dir, "asset_hits"), "asset_hits", "asset_path", "start_seconds", "end_seconds"))
    return streamed_periods_and_gaps(rows).withColumnRenamed("entity", "entity_key")


def p3_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per entity: number of periods and gaps and the milliseconds in each."""
    spans = p3_found(spark, sf_dir)
    ms = F.col("end_ms") - F.col("start_ms")
    return spans.groupBy("record_table", "entity_key").agg(
        F.count_if(F.col("span_kind") == "period").alias("periods"),
        F.count_if(F.col("span_kind") == "gap").alias("gaps"),
        F.sum(F.when(F.col("span_kind") == "period", ms).otherwise(0)).alias("covered_ms"),
        F.sum(F.when(F.col("span_kind") == "gap", ms).otherwise(0)).alias("gap_ms"),
    )


SPANS = """
with raw as (
  select 'chunk_segments' as record_table, video_key as entity_key, start_seconds as s, end_seconds as e from chunk_segments
  union all
  select 'asset_hits', asset_path, start_seconds, end_seconds from asset_hits
), usable as (
  select record_table, entity_key, cast(round(s * 1000) as bigint) as s, cast(round(e * 1000) as bigint) as e
  from raw where entity_key is not null and s is not null and e is not null and not isnan(s) and not isnan(e)
), ordered as (
  select *, max(e) over (partition by record_table, entity_key order by s, e rows between unbounded preceding and 1 preceding) as furthest
  from usable where e > s
), numbered as (
  select *, sum(case when furthest is null or s > furthest then 1 else 0 end)
    over (partition by record_table, entity_key order by s, e rows unbounded preceding) as island
  from ordered
), periods as (
  select record_table, entity_key, min(s) as s, max(e) as e from numbered group by record_table, entity_key, island
), spans as (
  select record_table, entity_key, 'period' as span_kind, s as start_ms, e as end_ms from periods
  union all
  select record_table, entity_key, 'gap', e, n from (
    select *, lead(s) over (partition by record_table, entity_key order by s) as n from periods) where n is not null
)
"""

QUERIES = {"p3_found": p3_found, "p3_coverage": p3_coverage}

ORACLES = {
    "p3_found": SPANS + "select record_table, entity_key, span_kind, start_ms, end_ms from spans",
    "p3_coverage": SPANS
    + """select record_table, entity_key,
  count(*) filter (where span_kind = 'period') as periods,
  count(*) filter (where span_kind = 'gap') as gaps,
  cast(coalesce(sum(end_ms - start_ms) filter (where span_kind = 'period'), 0) as bigint) as covered_ms,
  cast(coalesce(sum(end_ms - start_ms) filter (where span_kind = 'gap'), 0) as bigint) as gap_ms
from spans group by record_table, entity_key""",
}
