"""Queries that run over a table as a stream until its input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.intervals import intervals_of
from shelfspark.queries.intervals import SPANS
from shelfspark.session import fresh_path
from shelfspark.sources.streams import table_stream
from shelfspark.sources.tables import table
from shelfspark.streaming import keyed


def x6_interval_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods and gaps of the segments' videos from maps that a stream keeps, by eight arrivals."""
    rows = intervals_of(table(spark, sf_dir, "chunk_segments"), "chunk_segments", "video_key", "start_seconds", "end_seconds")
    return keyed.streamed_periods_and_gaps(rows).withColumnRenamed("entity", "entity_key")


def x5_drained_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits taken in by a drained stream, each key once, counted per kind."""
    path, checkpoint = fresh_path(spark, "drained"), fresh_path(spark, "progress")
    stream = table_stream(spark, sf_dir, "asset_hits", 8).where("hit_key is not null").select("hit_key", "file_kind", F.col("received_at").cast("timestamp").alias("at"))

    def take(batch: DataFrame, number: int) -> None:
        batch.groupBy("hit_key").agg(F.max("file_kind").alias("file_kind")).write.mode("overwrite").parquet(f"{path}/batch={number:06d}")

    keyed.drained(stream, take, checkpoint)
    taken = spark.read.schema("hit_key string, file_kind string").parquet(path)
    return taken.groupBy("hit_key").agg(F.max("file_kind").alias("kind")).groupBy("kind").agg(F.count("*").alias("keys"))


def x15_first_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type after repeats of one number were dropped by a stream with a watermark."""
    path, checkpoint = fresh_path(spark, "arrivals"), fresh_path(spark, "progress")
    stream = table_stream(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    keyed.run_to_table(keyed.first_arrivals(stream, ["event_id"], "60 days"), path, checkpoint)
    return spark.read.schema("event_id long, event_type string, at timestamp").parquet(path).groupBy("event_type").agg(F.count("*").alias("events"))


def d7_distinct_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user whose value differs in enough bits from the last accepted one within a day."""
    path, checkpoint = fresh_path(spark, "frames"), fresh_path(spark, "progress")
    code = F.lpad(F.hex(F.round(F.col("value") * 100).cast("long")), 16, "0")
    stream = table_stream(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("video"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), code.alias("hash"))
    keyed.run_to_table(keyed.distinct_frames(stream, bits=4, seconds=86_400.0), path, checkpoint)
    kept = spark.read.schema("video string, at double, hash string").parquet(path)
    return kept.groupBy("video").agg(F.count("*").alias("kept"), F.round(F.max("at"), 3).alias("last_at"))


QUERIES = {f.__name__: f for f in (x6_interval_stream, x5_drained_batches, x15_first_arrivals, d7_distinct_frames)}

ORACLES = {
    "x6_interval_stream": SPANS + "select record_table, entity_key, span_kind, start_ms, end_ms from spans where record_table = 'chunk_segments'",
    "x5_drained_batches": "select kind, count(*) as keys from (select hit_key, max(file_kind) as kind from asset_hits where hit_key is not null group by 1) group by 1",
    "x15_first_arrivals": "select event_type, count(distinct event_id) as events from events group by 1",
}
