"""Queries over segments of videos, captions, chunk plans and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.keys import hamming
from shelfspark.functions.media import chunk_plan, clock, frame_budget, stamped
from shelfspark.functions.text import collapsed, normalized_text, preview, space_slug
from shelfspark.operators import chunking, video
from shelfspark.operators.intervals import whole_ms
from shelfspark.sources.tables import spread, table


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of both lanes: the planned ones are the visual lane, stored records of videos the transcript lane."""
    planned = table(spark, sf_dir, "chunk_segments").select(
        F.split("video_key", ":").getItem(0).alias("site"),
        F.regexp_extract("video_key", "^[^:]*:(.*)$", 1).alias("video"),
        F.lit("visual").alias("lane"),
        F.col("segment_no").alias("order_no"),
        "segment_index",
        F.when(~F.isnan("end_seconds"), F.col("end_seconds")).alias("end_seconds"),
        F.unix_millis(F.col("planned_at").cast("timestamp")).alias("taken_ms"),
        F.col("library_root").alias("title"),
    )
    stored = table(spark, sf_dir, "vector_records").where("metadata.video_id <> ''").select(
        F.col("metadata.source_site").alias("site"),
        F.col("metadata.video_id").alias("video"),
        F.lit("transcript").alias("lane"),
        F.col("record_no").alias("order_no"),
        F.lit(None).cast("int").alias("segment_index"),
        F.lit(None).cast("double").alias("end_seconds"),
        F.col("metadata.stored_at_ms").alias("taken_ms"),
        F.coalesce("metadata.title", F.lit("")).alias("title"),
    )
    return planned.unionByName(stored)


def a1_video_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per video: segments of each lane, holes aside, duration, last time, first title."""
    return video.video_list(_segments(spark, sf_dir))


def a6_site_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos and segments per site over both lanes."""
    rows = _segments(spark, sf_dir)
    return rows.groupBy("site").agg(F.count_distinct("video").alias("videos"), F.count_if(F.col("lane") == "visual").alias("visual"), F.count_if(F.col("lane") == "transcript").alias("transcript"))


def a5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos, segments of each lane and the longest video."""
    return a1_video_list(spark, sf_dir).agg(F.count("*").alias("videos"), F.sum("visual_count").alias("visual"), F.sum("transcript_count").alias("transcript"), F.max("duration").alias("longest"))


def _held_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunk_segments").select(F.col("video_key").alias("video"), "segment_index", "start_seconds", "end_seconds", "effective_chunk_seconds", "planned_at")


def j9_missing_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of files that no hit has, before the last one that one has."""
    return video.missing_segments(table(spark, sf_dir, "asset_hits").where("asset_path is not null").select(F.col("asset_path").alias("video"), "segment_index"))


def a20_resume_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks in all and the next block to do, per video."""
    return video.resume_points(_held_rows(spark, sf_dir), F.col("effective_chunk_seconds"))


def a23_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks per video and state: whole, partial (shorter than planned), broken (no usable interval) or empty."""
    rows = _held_rows(spark, sf_dir).where("segment_index >= 0")
    length = whole_ms(F.col("end_seconds")) - whole_ms(F.col("start_seconds"))
    planned = whole_ms(F.col("effective_chunk_seconds"))
    rank = F.when(length >= planned, 0).when(length > 0, 1).otherwise(2)
    states = rows.select("video", F.col("segment_index").alias("block"), rank.alias("rank"), F.element_at(F.array(F.lit("whole"), F.lit("partial"), F.lit("broken")), rank + 1).alias("state"))
    totals = rows.groupBy("video").agg((F.max("segment_index") + 1).alias("total_blocks"))
    return video.timeline(states, totals).groupBy("video", "state").agg(F.count("*").alias("blocks"))


def j6_library_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per video over both lanes: last title that is not blank, segments, longest end."""
    rows = _segments(spark, sf_dir)
    parts = rows.select(
        "video",
        F.when(F.col("lane") == "visual", 1).otherwise(2).alias("place"),
        "order_no",
        "title",
        F.col("site").alias("last_site"),
        (F.col("lane") == "visual").cast("long").alias("visual"),
        (F.col("lane") == "transcript").cast("long").alias("transcript"),
        F.col("end_seconds").alias("duration"),
        F.col("taken_ms").alias("last_ms"),
    )
    return video.merged_summary(parts, ["title", "last_site"], ["visual", "transcript"], ["duration", "last_ms"])


def j7_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last activity of each video over planned and stored segments."""
    rows = _segments(spark, sf_dir)
    last = rows.where("lane = 'transcript'").groupBy("video").agg(F.max("taken_ms").alias("stored_ms"))
    planned = rows.where("lane = 'visual'").groupBy("video").agg(F.max("taken_ms").alias("planned_ms"))
    return planned.join(last, "video", "left").select("video", F.greatest("planned_ms", "stored_ms").alias("last_ms"))


def a24_recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos per site that were planned in the last 24 hours of the table."""
    rows = _segments(spark, sf_dir).where("lane = 'visual'").groupBy("site", "video").agg(F.max("taken_ms").alias("last_ms"))
    newest = table(spark, sf_dir, "chunk_segments").agg(F.max(F.unix_millis(F.col("planned_at").cast("timestamp")))).first()[0]  # one number
    return rows.where(F.col("last_ms") >= F.lit(newest) - 86400000).groupBy("site").agg(F.count("*").alias("videos"))


def x2_media_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events per user in windows of ten days: a run ends with the window or after a pause of more than two days."""
    ticks = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("video"), F.col("event_id").alias("arrival"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("position"))
    found = video.media_segments(ticks, seconds=864000.0, back=0.0, ahead=172800.0, frame=0.5, least_frames=2)
    return found.select("video", "segment_index", "frames", F.round("captured", 3).alias("captured"), "began")


def x4_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct titles of the records of each video in the order in which they were stored."""
    cues = table(spark, sf_dir, "vector_records").where("metadata.video_id <> ''").select(F.col("metadata.video_id").alias("video"), F.lit(0).alias("segment_index"), F.col("metadata.title").alias("caption"), "record_no")
    return video.captions_per_segment(cues, F.col("record_no")).select("video", "text")


def x3_caption_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of the segments' folders as captions of each video, joined into windows of 25 s or 180 characters."""
    cues = table(spark, sf_dir, "chunk_segments").select(F.col("video_key").alias("video"), "start_seconds", "end_seconds", F.concat_ws(" ", "library_root", F.col("segment_index").cast("string")).alias("caption"))
    return chunking.caption_chunks(cues.where("not isnan(start_seconds) and not isnan(end_seconds)"))


def f2_document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document."""
    return chunking.document_chunks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text").withColumn("characters", F.length("text")).drop("text")


def f1_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of every document after normalising, and a digest of it."""
    text = normalized_text(F.col("text"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.length(text).alias("characters"), F.md5(text).alias("digest"))


def s18_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beginning of every chunk in one line."""
    return table(spark, sf_dir, "document_chunks").where("text is not null").select("chunk_no", preview(F.col("text")).alias("preview"))


def x9_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that are not blank once white space is collapsed, per file: how many and how long."""
    rows = table(spark, sf_dir, "document_chunks").select("asset_path", collapsed(F.col("text")).alias("text")).where("text <> ''")
    return rows.groupBy("asset_path").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("characters"))


def f15_chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan of every video of the hits: chunk length, segments and where the last one ends."""
    hits = table(spark, sf_dir, "asset_hits").where("file_kind = 'video' and not isnan(duration)").groupBy("asset_path").agg(F.max("duration").alias("duration"))
    plan = hits.withColumn("plan", chunk_plan(F.col("duration"), F.lit(32768), most=10)).where("plan is not null")
    return plan.select("asset_path", "plan.chunk_seconds", "plan.stretched", F.size("plan.segments").alias("segments"), F.element_at("plan.segments", -1).getField("end_seconds").alias("last_end"))


def f15_frame_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames per context length, taken from the vectors per sample."""
    rows = table(spark, sf_dir, "ingest_samples").select((F.col("vectors") * 100).alias("context")).distinct()
    return rows.select("context", frame_budget(F.col("context")).alias("frames"))


def f18_stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address of every planned segment at its start."""
    rows = table(spark, sf_dir, "chunk_segments").where("start_seconds is not null and not isnan(start_seconds)")
    url = F.concat(F.lit("https://"), F.split("video_key", ":").getItem(0), F.lit(".test/watch?v="), F.regexp_extract("video_key", "^[^:]*:(.*)$", 1))
    return rows.select("segment_no", stamped(url, F.col("start_seconds")).alias("url"))


def f26_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start of every planned segment as a clock."""
    rows = table(spark, sf_dir, "chunk_segments").where("start_seconds >= 0 and not isnan(start_seconds)")
    return rows.select("segment_no", clock(F.col("start_seconds")).alias("clock"))


def f23_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differing bits between the beginnings of the keys of consecutive records."""
    rows = table(spark, sf_dir, "vector_records").select("record_no", F.substring(F.md5("vec_key"), 1, 16).alias("h"))
    other = rows.select((F.col("record_no") + 1).alias("record_no"), F.col("h").alias("before"))
    return rows.join(other, "record_no").select("record_no", hamming(F.col("h"), F.col("before")).alias("bits"))


def f8_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the embedding spaces of the samples' models."""
    rows = table(spark, sf_dir, "ingest_samples").groupBy("embedding_model", "embedding_dimension").agg(F.count("*").alias("samples"))
    return rows.select("samples", space_slug(F.col("embedding_model"), F.col("embedding_dimension"), F.lit("plain"), "v1").alias("space"))


QUERIES = {
    f.__name__: f
    for f in (
        a1_video_list, a6_site_stats, a5_totals, j9_missing_segments, a20_resume_points, a23_timeline, j6_library_summary, j7_activity, a24_recent_history,
        x2_media_segments, x4_captions, x3_caption_chunks, f2_document_chunks, f1_normalized, s18_previews, x9_transcripts, f15_chunk_plan,
        f15_frame_budgets, f18_stamped, f26_clock, f23_hamming, f8_spaces,
    )
}

_BLANK = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\x{0B}]"
_SEGMENTS = """with segments as (
  select string_split(video_key, ':')[1] as site, regexp_extract(video_key, '^[^:]*:(.*)$', 1) as video, 'visual' as lane, segment_no as order_no, segment_index,
    case when not isnan(end_seconds) then end_seconds end as end_seconds, epoch_us(planned_at) // 1000 as taken_ms, library_root as title from chunk_segments
  union all
  select metadata.source_site, metadata.video_id, 'transcript', record_no, null, null, metadata.stored_at_ms, coalesce(metadata.title, '') from vector_records where metadata.video_id <> ''
)
"""
_LIST = _SEGMENTS + """, videos as (select site, video, count(*) filter (where lane = 'visual') as visual_count, count(*) filter (where lane = 'transcript') as transcript_count,
  count(distinct case when lane = 'visual' and segment_index >= 0 then segment_index end) as visual_segments, max(case when segment_index >= 0 then segment_index end) as last_segment,
  max(end_seconds) as duration, max(taken_ms) as taken_ms, arg_min(title, (case when lane <> 'visual' then 1 else 0 end, order_no)) as title
  from segments where video <> '' group by site, video)
"""
_MS = "cast(round(case when not isnan({c}) and abs({c}) <= 9e12 then {c} end * 1000) as bigint)"

ORACLES = {
    "a1_video_list": _LIST + "select * from videos",
    "a6_site_stats": _SEGMENTS + """select site, count(distinct video) as videos, count(*) filter (where lane = 'visual') as visual,
  count(*) filter (where lane = 'transcript') as transcript from segments group by site""",
    "a5_totals": _LIST + "select count(*) as videos, cast(sum(visual_count) as bigint) as visual, cast(sum(transcript_count) as bigint) as transcript, max(duration) as longest from videos",
    "j9_missing_segments": """with known as (select distinct asset_path as video, segment_index from asset_hits where segment_index >= 0 and asset_path is not null
), wanted as (select video, unnest(range(0, max(segment_index) + 1)) as segment_index from known group by video)
select video, cast(segment_index as integer) as segment_index from wanted except select video, segment_index from known""",
    "a20_resume_points": """with known as (select video_key as video, coalesce(max(case when segment_index >= 0 then segment_index end), -1) as last_known,
  max(case when not isnan(end_seconds) then end_seconds end) as duration, max(effective_chunk_seconds) as step from chunk_segments group by 1
), blocks as (select *, greatest(last_known + 1, cast(ceil(coalesce(duration, 0) / step) as integer)) as n from known)
select video, n as total_blocks, case when last_known + 1 >= n then -1 else last_known + 1 end as resume_at from blocks""",
    "a23_timeline": f"""with rows as (select video_key as video, segment_index as block, {_MS.format(c="end_seconds")} - {_MS.format(c="start_seconds")} as length,
  {_MS.format(c="effective_chunk_seconds")} as planned from chunk_segments where segment_index >= 0
), best as (select video, block, min(case when length >= planned then 0 when length > 0 then 1 else 2 end) as rank from rows group by 1, 2
), blocks as (select video, unnest(range(0, max(block) + 1)) as block from rows group by video)
select video, case rank when 0 then 'whole' when 1 then 'partial' when 2 then 'broken' else 'empty' end as state, count(*) as blocks
from blocks left join best using (video, block) group by 1, 2""",
    "j6_library_summary": _SEGMENTS + """select video, arg_max(nullif(title, ''), (case when lane = 'visual' then 1 else 2 end, order_no)) filter (where title <> '') as title,
  arg_max(nullif(site, ''), (case when lane = 'visual' then 1 else 2 end, order_no)) filter (where site <> '') as last_site,
  count(*) filter (where lane = 'visual') as visual, count(*) filter (where lane = 'transcript') as transcript, max(end_seconds) as duration, max(taken_ms) as last_ms
from segments where video <> '' group by video""",
    "j7_activity": _SEGMENTS + """select video, greatest(max(taken_ms) filter (where lane = 'visual'), max(taken_ms) filter (where lane = 'transcript')) as last_ms
from segments group by video having count(*) filter (where lane = 'visual') > 0""",
    "a24_recent_history": _SEGMENTS + """, videos as (select site, video, max(taken_ms) as last_ms from segments where lane = 'visual' group by 1, 2)
select site, count(*) as videos from videos where last_ms >= (select max(last_ms) from videos) - 86400000 group by site""",
    "x2_media_segments": """with ticks as (select user_id::varchar as video, event_id as arrival, epoch_us(ts) / 1e6 as position from events
), steps as (select *, floor(position / 864000) as segment_index, position - lag(position) over w as step, lag(floor(position / 864000)) over w as before
  from ticks window w as (partition by video order by arrival, position)
), runs as (select *, sum(case when step is null or step < 0 or step > 172800 or segment_index <> before then 1 else 0 end) over (partition by video order by arrival, position rows unbounded preceding) as run from steps
), found as (select video, cast(segment_index as bigint) as segment_index, count(*) as frames, max(position) - min(position) + 0.5 as captured, min(arrival) as began from runs group by video, run, segment_index)
select video, segment_index, frames, round(captured, 3) as captured, began from found where frames >= 2 and captured >= 0.8 * 864000""",
    "x4_captions": """with first as (select metadata.video_id as video, metadata.title as caption, min(record_no) as first_at from vector_records
  where metadata.video_id <> '' and metadata.title <> '' group by 1, 2)
select video, string_agg(caption, ' ' order by first_at, caption) as text from first group by 1""",
    "f1_normalized": rf"""with t as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '\r\n?', chr(10), 'g'), '\x00', ' ', 'g'), '[\t\f\x{{0B}}]+', ' ', 'g'), '[ \x{{A0}}]+\n', chr(10), 'g'), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '^{_BLANK}+', ''), '{_BLANK}+$', '') as text
  from documents where text is not null)
select doc_id, cast(length(text) as integer) as characters, md5(text) as digest from t""",
    "s18_previews": rf"""select chunk_no, substr(trim(regexp_replace(text, '{_BLANK}+', ' ', 'g')), 1, 280) as preview from document_chunks where text is not null""",
    "x9_transcripts": rf"""with t as (select asset_path, trim(regexp_replace(text, '{_BLANK}+', ' ', 'g')) as text from document_chunks)
select asset_path, count(*) as chunks, cast(sum(length(text)) as bigint) as characters from t where text <> '' group by 1""",
    "f15_chunk_plan": """with v as (select asset_path, max(duration) as d from asset_hits where file_kind = 'video' and not isnan(duration) group by 1
), p as (select asset_path, d, case when ceil(d / 30) > 10 then cast(ceil(d / 10) as bigint) else 30 end as chunk from v where d > 0)
select asset_path, chunk as chunk_seconds, chunk > 30 as stretched, cast(ceil(d / chunk) as integer) as segments, round(d, 3) as last_end from p""",
    "f15_frame_budgets": """select distinct vectors * 100 as context, cast(greatest(1, floor((case when vectors > 0 then vectors * 100 else 32768 end) * 0.5 / 110)) as integer) as frames from ingest_samples""",
    "f18_stamped": """select segment_no, 'https://' || string_split(video_key, ':')[1] || '.test/watch?v=' || regexp_extract(video_key, '^[^:]*:(.*)$', 1) || '&t='
  || cast(greatest(floor(start_seconds), 0) as bigint)::varchar || 's' as url from chunk_segments where start_seconds is not null and not isnan(start_seconds)""",
    "f26_clock": """with t as (select segment_no, cast(floor(start_seconds) as bigint) as s from chunk_segments where start_seconds >= 0 and not isnan(start_seconds))
select segment_no, case when s >= 3600 then printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) else printf('%d:%02d', s // 60 % 60, s % 60) end as clock from t""",
    "f23_hamming": """with h as (select record_no, cast(('0x' || substr(md5(vec_key), 1, 16)) as ubigint) as h from vector_records)
select a.record_no, cast(coalesce(bit_count(xor(a.h, b.h)), 64) as integer) as bits from h a join h b on b.record_no = a.record_no - 1""",
    "f8_spaces": r"""select count(*) as samples, regexp_replace(regexp_replace(lower(embedding_model) || '-' || embedding_dimension::varchar || '-plain-v1', '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') as space
from ingest_samples group by embedding_model, embedding_dimension""",
}
