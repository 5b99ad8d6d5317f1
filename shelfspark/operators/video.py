"""Segments of videos: lists, summaries, holes and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def video_list(segments: DataFrame) -> DataFrame:
    """One row per site and video over tagged segments (site, video, lane, order_no, segment_index, end_seconds, taken_ms, title).

    Counts per lane, distinct segments, longest end, last time; the title is that of the first row, visual rows first.
    """
    first = F.min_by("title", F.struct((F.col("lane") != "visual").alias("late"), F.col("order_no")))
    index = F.when(F.col("segment_index") >= 0, F.col("segment_index"))
    return (
        segments.where((F.col("video") != "") & F.col("video").isNotNull())
        .groupBy("site", "video")
        .agg(
            F.count_if(F.col("lane") == "visual").alias("visual_count"),
            F.count_if(F.col("lane") == "transcript").alias("transcript_count"),
            F.count_distinct(F.when(F.col("lane") == "visual", index)).alias("visual_segments"),
            F.max(index).alias("last_segment"),
            F.max(F.when(~F.isnan("end_seconds"), F.col("end_seconds"))).alias("duration"),
            F.max("taken_ms").alias("taken_ms"),
            first.alias("title"),
        )
    )


def missing_segments(segments: DataFrame) -> DataFrame:
    """(video, segment_index): what lacks between 0 and the last segment that a video has."""
    known = segments.where(F.col("segment_index") >= 0).select("video", "segment_index").distinct()
    wanted = known.groupBy("video").agg(F.max("segment_index").alias("last")).select("video", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("segment_index"))
    return wanted.join(known, ["video", "segment_index"], "left_anti")


def resume_points(segments: DataFrame, interval: Column) -> DataFrame:
    """Per video: blocks in all (from the last segment or the duration), the next block to do, or -1 when done."""
    known = segments.groupBy("video").agg(
        F.coalesce(F.max(F.when(F.col("segment_index") >= 0, F.col("segment_index"))), F.lit(-1)).alias("last_known"),
        F.max(F.when(~F.isnan("end_seconds"), F.col("end_seconds"))).alias("duration"),
        F.max(interval).alias("interval"),
    )
    blocks = F.greatest(F.col("last_known") + 1, F.ceil(F.coalesce("duration", F.lit(0.0)) / F.col("interval")).cast("int"))
    return known.select("video", blocks.alias("total_blocks"), F.when(F.col("last_known") + 1 >= blocks, -1).otherwise(F.col("last_known") + 1).alias("resume_at"))


def timeline(states: DataFrame, totals: DataFrame) -> DataFrame:
    """(video, block, state): one state per block by rank; blocks of no state are ``empty``.

    ``states`` has (video, block, rank, state), lower ranks win; ``totals`` has (video, total_blocks).
    """
    best = states.groupBy("video", "block").agg(F.min_by("state", "rank").alias("state"))
    blocks = totals.where("total_blocks > 0").select("video", F.explode(F.sequence(F.lit(0), F.col("total_blocks") - 1)).alias("block"))
    return blocks.join(best, ["video", "block"], "left").withColumn("state", F.coalesce("state", F.lit("empty")))


def merged_summary(parts: DataFrame, texts: list[str], sums: list[str], peaks: list[str]) -> DataFrame:
    """One row per video over parts tagged with the place of their source: the last text that is not blank, sums, peaks."""
    at = F.struct("place", "order_no")
    aggregates = [F.max_by(F.nullif(F.col(t), F.lit("")), F.when(F.nullif(F.col(t), F.lit("")).isNotNull(), at)).alias(t) for t in texts]
    aggregates += [F.sum(F.coalesce(s, F.lit(0))).alias(s) for s in sums] + [F.max(p).alias(p) for p in peaks]
    return parts.where("video is not null and video <> ''").groupBy("video").agg(*aggregates)


def media_segments(ticks: DataFrame, seconds: float = 10.0, back: float = 0.75, ahead: float = 1.5, frame: float = 0.5, least_frames: int = 3) -> DataFrame:
    """Captured segments from (video, arrival, position): a segment ends at a multiple of ``seconds`` or at a jump.

    A jump is a step back by more than ``back`` or ahead by more than ``ahead``. Kept are segments with enough frames that
    cover at least 80 % of what they should.
    """
    by_video = W.partitionBy("video").orderBy("arrival", "position")
    step = F.col("position") - F.lag("position").over(by_video)
    index = F.floor(F.col("position") / seconds)
    opens = step.isNull() | (step < -back) | (step > ahead) | (index != F.lag(index).over(by_video))
    runs = ticks.withColumns({"segment_index": index, "_opens": opens}).withColumn("run", F.sum(F.col("_opens").cast("int")).over(by_video.rowsBetween(W.unboundedPreceding, 0)))
    return (
        runs.groupBy("video", "run", "segment_index")
        .agg(F.count("*").alias("frames"), (F.max("position") - F.min("position") + frame).alias("captured"), F.min("arrival").alias("began"))
        .where((F.col("frames") >= least_frames) & (F.col("captured") >= max(0.75, 0.8 * seconds)))
        .select("video", "run", "segment_index", "frames", "captured", "began")
    )


def captions_per_segment(cues: DataFrame, *order: Column) -> DataFrame:
    """(video, segment_index, text): distinct captions of a segment in the order of arrival, joined by spaces."""
    first = cues.where("caption is not null and caption <> ''").groupBy("video", "segment_index", "caption").agg(F.min(F.struct(*order)).alias("at"))
    return first.groupBy("video", "segment_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "caption"))), lambda x: x["caption"]), " ").alias("text"))
