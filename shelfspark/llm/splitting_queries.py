"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.splitting import segment_pieces, text_pieces
from shelfspark.operators.intervals import whole_ms
from shelfspark.sources.tables import table


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_pieces(table(spark, sf_dir, "document_chunks"), "chunk_no", "text", "start_character")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_pieces(
        table(spark, sf_dir, "chunk_segments"), "segment_no", whole_ms(F.col("start_seconds")), whole_ms(F.col("end_seconds")), whole_ms(F.col("effective_chunk_seconds"))
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows over the limit: those that come out as more than one piece."""
    second = F.col("piece_no") == 2
    return (
        _texts(spark, sf_dir)
        .where(second)
        .select(F.lit("document_chunks").alias("record_table"), "record_no")
        .unionByName(_segments(spark, sf_dir).where(second).select(F.lit("chunk_segments").alias("record_table"), "record_no"))
    )


def p2_text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of document_chunks as pieces within 3600 characters."""
    return _texts(spark, sf_dir).withColumnRenamed("record_no", "chunk_no")


def p2_segment_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of chunk_segments as pieces within 60 s."""
    return _segments(spark, sf_dir).select(
        F.col("record_no").alias("segment_no"), "piece_no", (F.col("start_ms") / 1000).alias("start_seconds"), (F.col("end_ms") / 1000).alias("end_seconds"), "cut_strength"
    )


QUERIES = {"p2_found": p2_found, "p2_text_pieces": p2_text_pieces, "p2_segment_pieces": p2_segment_pieces}

ORACLES = {
    "p2_found": r"""
select 'document_chunks' as record_table, chunk_no as record_no from document_chunks
where length(regexp_replace(regexp_replace(text, '^[\s\p{Z}\x1C-\x1F\x{85}]+', ''), '[\s\p{Z}\x1C-\x1F\x{85}]+$', '')) > 3600
union all
select 'chunk_segments', segment_no from chunk_segments
where start_seconds is not null and end_seconds is not null and not isnan(start_seconds) and not isnan(end_seconds)
  and cast(round(end_seconds * 1000) as bigint) - cast(round(start_seconds * 1000) as bigint) > 60000""",
}
