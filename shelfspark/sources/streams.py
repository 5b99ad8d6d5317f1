"""Streaming readers of the asset tables and of captured payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAYLOAD = "kind string, site string, video string, segment_index int, start_time double, end_time double, text string, captured_at timestamp"


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    # a pattern, as a stream takes a single file for a folder otherwise
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(f"{path[:-1]}[{path[-1]}]")


def payload_stream(spark: SparkSession, path: str) -> DataFrame:
    """Captured payloads, one JSON object per line; lines that are none are dropped."""
    return spark.readStream.schema(PAYLOAD).option("mode", "DROPMALFORMED").json(path)
