"""Queries that reshape rows: web hits, partners, lookups with fallback, identities, fan-out, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.functions.keys import segment_key, short_digest
from shelfspark.functions.media import stamped
from shelfspark.functions.paths import EDITABLE, MEDIA, extension, folder, stem
from shelfspark.functions.text import preview, safe_name
from shelfspark.operators import library, search
from shelfspark.sources.tables import table


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "asset_hits")


def _web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored records of videos as web hits; a record without site or video has no address."""
    m = lambda f: F.coalesce(f"metadata.{f}", F.lit("")).alias(f)
    rows = table(spark, sf_dir, "vector_records").select("record_no", m("source_site"), m("video_id"), m("title"), F.col("metadata.stored_at_ms").alias("stored_at_ms"))
    address = F.when((F.col("source_site") != "") & (F.col("video_id") != ""), F.concat(F.lit("https://"), "source_site", F.lit(".test/watch?v="), "video_id")).otherwise("")
    return rows.withColumn("address", address).withColumn("start_seconds", F.pmod(F.col("stored_at_ms"), F.lit(600)).cast("double"))


def pr4_web_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web hits as asset hits at their position; those without an address are dropped."""
    rows = _web(spark, sf_dir).withColumn("url", stamped(F.col("address"), F.col("start_seconds"))).where("url <> ''")
    return rows.select("record_no", "url", F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")).alias("title"), "start_seconds", F.greatest("start_seconds", F.lit(60.0)).alias("end_seconds"))


def f19_video_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site and video read back from the address of each web hit, counted per site."""
    url = F.col("address")
    rows = _web(spark, sf_dir).where("address <> ''").select(F.regexp_extract(F.parse_url(url, F.lit("HOST")), r"([a-z]+)\.test$", 1).alias("site"), F.parse_url(url, F.lit("QUERY"), F.lit("v")).alias("video"))
    return rows.groupBy("site").agg(F.count_distinct("video").alias("videos"), F.count("*").alias("hits"))


def pr6_asset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents as index rows: defaults for what is missing, preview, key of the chunk."""
    chunks = table(spark, sf_dir, "document_chunks").where("asset_path is not null")
    start = F.coalesce("start_character", F.lit(0))
    return chunks.select(
        "chunk_no",
        F.lit("document").alias("file_kind"),
        F.coalesce("chunk_index", F.lit(0)).alias("segment_index"),
        start.alias("character_start"),
        (start + F.length(F.coalesce("text", F.lit("")))).alias("character_end"),
        F.coalesce(preview(F.col("text")), F.lit("")).alias("text_preview"),
        segment_key(F.lit("local"), F.lit("document"), F.col("asset_path"), F.lit("v1"), F.coalesce("chunk_index", F.lit(0)), F.lit("s")).alias("key"),
    )


def pr10_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with all but the ends of their names hidden."""
    name = F.col("supplier_label")
    hidden = F.when(F.length(name) <= 4, F.repeat(F.lit("*"), F.length(name))).otherwise(F.concat(F.substring(name, 1, 2), F.lit("…"), F.right(name, F.lit(2))))
    return table(spark, sf_dir, "ingest_samples").groupBy(hidden.alias("masked")).agg(F.count_distinct("supplier_label").alias("suppliers"))


def f27_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts and ports of the suppliers."""
    rows = table(spark, sf_dir, "ingest_samples").select(F.split("supplier_label", ":").alias("p"))
    return rows.groupBy(F.lower(F.col("p")[0]).alias("host"), F.try_element_at("p", F.lit(2)).try_cast("int").alias("port")).agg(F.count("*").alias("samples"))


def f10_safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe names of the titles and how many titles share one."""
    rows = table(spark, sf_dir, "vector_records").select(F.col("metadata.title").alias("title")).where("title is not null")
    return rows.groupBy(safe_name(F.col("title")).alias("name")).agg(F.count_distinct("title").alias("titles"))


def f9_workloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of what a workload consists of, with its samples."""
    digest = short_digest(F.col("provider_key"), F.col("embedding_model"), F.col("embedding_dimension").cast("string"), F.col("document_chunk_version"))
    return table(spark, sf_dir, "ingest_samples").groupBy(digest.alias("digest")).agg(F.count("*").alias("samples"), F.count_distinct("workload_key").alias("workloads"))


def a7_row_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of vectors, keys and titles per space."""
    rows = table(spark, sf_dir, "vector_records")
    size = 4 * F.coalesce(F.size("data_float32"), F.lit(0)) * F.col("data_float32").isNotNull().cast("int") + F.octet_length(F.coalesce("vec_key", F.lit(""))) + F.octet_length(F.coalesce("metadata.title", F.lit("")))
    return rows.groupBy(F.coalesce("metadata.embedding_space", F.lit("")).alias("space")).agg(F.sum(size).cast("long").alias("bytes"), F.count("*").alias("records"))


def a21_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples, mean and last time per storage provider."""
    rows = table(spark, sf_dir, "ingest_samples").where("elapsed_ms > 0")
    return rows.groupBy("storage_provider").agg(F.count("*").alias("samples"), F.round(F.avg("elapsed_ms"), 3).alias("mean_ms"), F.max_by("elapsed_ms", F.struct("sampled_at_ms", "sample_no")).alias("last_ms"))


def j4_media_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each note, the first media file of the same stem in the same folder."""
    paths = _hits(spark, sf_dir).select(F.col("asset_path").alias("path")).union(table(spark, sf_dir, "document_chunks").select("asset_path")).where("path is not null").distinct()
    keyed = paths.select("path", stem(F.col("path")).alias("stem"), folder(F.col("path")).alias("folder"), extension(F.col("path")).alias("ext"))
    notes, media = keyed.where(F.col("ext").isin(*EDITABLE)), keyed.where(F.col("ext").isin(*MEDIA))
    first = media.groupBy("stem", "folder").agg(F.min("path").alias("partner"))
    return notes.join(first, ["stem", "folder"], "left").select("path", "partner")


def j5_preview_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time of each hit of a late batch in the early ones: by its key, else by path and segment."""
    early, late = _hits(spark, sf_dir).where("batch_no <= 10"), _hits(spark, sf_dir).where("batch_no > 10")
    by_key = early.where("hit_key is not null").groupBy("hit_key").agg(F.max("hit_no").alias("by_key"))
    by_place = early.groupBy("asset_path", "segment_index").agg(F.max("hit_no").alias("by_place"))
    found = late.join(by_key, "hit_key", "left").join(by_place, ["asset_path", "segment_index"], "left")
    return found.select("hit_no", F.coalesce("by_key", "by_place").alias("earlier_no"))


def j15_already_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each batch whose key no earlier batch had: only these need a vector."""
    rows = table(spark, sf_dir, "vector_records").where("vec_key is not null")
    first = rows.groupBy("vec_key").agg(F.min("batch_no").alias("batch_no"))
    return rows.join(first, ["vec_key", "batch_no"], "left_semi").groupBy("batch_no").agg(F.count("*").alias("new_records"))


def d3_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hit of each file in the order of arrival."""
    return search.first_of(_hits(spark, sf_dir).where("asset_path is not null"), ["asset_path"], F.col("batch_no"), F.col("hit_no")).select("asset_path", "hit_no")


def q6_list_then_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 400 hits that arrived, then the newest 100 of them: the limit stands before the sort."""
    known = F.when(~F.isnan("modified_at"), F.col("modified_at"))
    return _hits(spark, sf_dir).orderBy("batch_no", "hit_no").limit(400).orderBy(F.desc_nulls_last(known), "hit_no").limit(100).select("hit_no", "asset_path")


def q2_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local and web hits in one list: the best passage per document, one web hit per second, the 60 best of both."""
    hits = _hits(spark, sf_dir).where("hit_key is not null and not isnan(score)")
    local = search.best_passage(hits, F.col("asset_path"), F.col("file_kind"), F.col("legacy"), F.col("hit_key"), F.col("score"), F.col("hit_no"))
    web = _web(spark, sf_dir).where("address <> ''").withColumns({"score": F.pmod("record_no", F.lit(101)) / 101.0, "lane": F.lit(0)})
    one = search.web_dedupe(web, F.col("source_site"), F.col("video_id"), F.col("start_seconds"), F.col("lane"), "score", "title", F.col("record_no"))
    shape = lambda rows, number: rows.select(F.col(number).alias("no"), F.round("score", 6).alias("score"))
    return search.merged_sources(shape(local, "hit_no"), shape(one, "record_no"), "score", 60, F.col("no"))


def t7_library_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots by the number of their assets, then by name as people sort it, with their place."""
    counts = _hits(spark, sf_dir).groupBy("library_root").agg(F.count_distinct("asset_path").alias("assets"))
    return counts.select("library_root", "assets", F.rank().over(W.orderBy(F.desc("assets"))).alias("place"))  # one row per registered root


def u5_segments_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each file seen early, late, and in either."""
    arrays = _hits(spark, sf_dir).where("asset_path is not null").groupBy("asset_path").agg(
        F.collect_set(F.when(F.col("batch_no") <= 10, F.col("segment_index"))).alias("early"), F.collect_set(F.when(F.col("batch_no") > 10, F.col("segment_index"))).alias("late")
    )
    return arrays.select("asset_path", F.size("early").alias("early"), F.size("late").alias("late"), F.size(F.array_union("early", "late")).alias("either"))


def x7_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record as one item for its vector and one for its title, if it has one; counted per kind and kind of file."""
    rows = table(spark, sf_dir, "vector_records")
    items = F.array_compact(F.array(F.lit("vector"), F.when(F.coalesce("metadata.title", F.lit("")) != "", F.lit("title"))))
    return rows.select(F.explode(items).alias("item"), F.coalesce("metadata.file_kind", F.lit("")).alias("file_kind")).groupBy("item", "file_kind").agg(F.count("*").alias("items"))


def s7_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child folders of each folder above the files of hits, whether registered as a root, and how many files lie below."""
    from shelfspark.functions.paths import ancestors

    files = _hits(spark, sf_dir).where("asset_path like '/%'").select(F.col("asset_path").alias("path")).distinct()
    above = files.select(F.explode(ancestors(folder(F.col("path")))).alias("child")).groupBy("child").agg(F.count("*").alias("files"))
    roots = table(spark, sf_dir, "library_roots").select(F.col("library_root").alias("child"), F.lit(True).alias("registered"))
    return above.join(roots, "child", "left").select(folder(F.col("child")).alias("parent"), "child", F.coalesce("registered", F.lit(False)).alias("registered"), "files")


def s19_sidecar_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of the nearest text file of each file's stem."""
    chunks = table(spark, sf_dir, "document_chunks").where("asset_path is not null")
    paths = _hits(spark, sf_dir).select(F.col("asset_path").alias("path")).union(chunks.select("asset_path")).where("path is not null").distinct()
    texts = chunks.where("text is not null").groupBy("asset_path").agg(F.min_by("text", F.struct("chunk_index", "chunk_no")).alias("text"))
    partners = library.sidecars(paths, paths)
    return partners.join(texts, partners["partner"] == texts["asset_path"], "left").select("path", "partner", F.length(preview(F.col("text"), 1120)).alias("characters"))


QUERIES = {
    f.__name__: f
    for f in (
        pr4_web_assets, f19_video_identity, pr6_asset_rows, pr10_masked, f27_endpoints, f10_safe_names, f9_workloads, a7_row_bytes, a21_latencies, j4_media_partner,
        j5_preview_fallback, j15_already_stored, d3_first_seen, q6_list_then_sort, q2_search_all, t7_library_order, u5_segments_known, x7_fan_out, s7_browse, s19_sidecar_text,
    )
}

_WEB = """with web as (
  select record_no, coalesce(metadata.source_site, '') as source_site, coalesce(metadata.video_id, '') as video_id, coalesce(metadata.title, '') as title,
    metadata.stored_at_ms as stored_at_ms, (metadata.stored_at_ms % 600)::double as start_seconds from vector_records
), addressed as (select *, 'https://' || source_site || '.test/watch?v=' || video_id as address from web where source_site <> '' and video_id <> '')
"""
_BLANK = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\x{0B}]"
_FOLDER = "regexp_replace({p}, '/[^/]*$', '')"
_STEM = r"lower(regexp_replace(list_extract(string_split({p}, '/'), -1), '\.[^.]*$', ''))"
_EXT = r"lower(regexp_extract({p}, '\.([^./\\]+)$', 1))"

ORACLES = {
    "pr4_web_assets": _WEB + """select record_no, address || '&t=' || cast(floor(start_seconds) as bigint)::varchar || 's' as url, coalesce(nullif(title, ''), 'Untitled') as title,
  start_seconds, greatest(start_seconds, 60.0) as end_seconds from addressed""",
    "f19_video_identity": _WEB + "select source_site as site, count(distinct video_id) as videos, count(*) as hits from addressed group by 1",
    "pr6_asset_rows": rf"""with d as (select *, coalesce(start_character, 0) as s, coalesce(chunk_index, 0) as i,
  sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('local:document:' || asset_path || ':v1:' || coalesce(chunk_index, 0) || ':s')) as h from document_chunks where asset_path is not null)
select chunk_no, 'document' as file_kind, i as segment_index, s as character_start, s + length(coalesce(text, '')) as character_end,
  coalesce(substr(trim(regexp_replace(text, '{_BLANK}+', ' ', 'g')), 1, 280), '') as text_preview,
  h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || case when h[17] in ('0', '4', '8', 'c') then '8' when h[17] in ('1', '5', '9', 'd') then '9'
  when h[17] in ('2', '6', 'a', 'e') then 'a' else 'b' end || h[18] || h[19:20] || '-' || h[21:32] as key from d""",
    "pr10_masked": """select case when length(supplier_label) <= 4 then repeat('*', length(supplier_label)) else supplier_label[1:2] || '…' || supplier_label[-2:] end as masked,
  count(distinct supplier_label) as suppliers from ingest_samples group by 1""",
    "f27_endpoints": "select lower(string_split(supplier_label, ':')[1]) as host, try_cast(string_split(supplier_label, ':')[2] as integer) as port, count(*) as samples from ingest_samples group by 1, 2",
    "f10_safe_names": """select substr(regexp_replace(lower(metadata.title), '[^a-z0-9_-]+', '_', 'g'), 1, 24) as name, count(distinct metadata.title) as titles
from vector_records where metadata.title is not null group by 1""",
    "f9_workloads": """select substr(sha256(concat_ws(chr(31), provider_key, embedding_model, embedding_dimension::varchar, document_chunk_version)), 1, 24) as digest,
  count(*) as samples, count(distinct workload_key) as workloads from ingest_samples group by 1""",
    "a7_row_bytes": """select coalesce(metadata.embedding_space, '') as space, cast(sum(4 * coalesce(len(data_float32), 0) + strlen(coalesce(vec_key, '')) + strlen(coalesce(metadata.title, ''))) as bigint) as bytes,
  count(*) as records from vector_records group by 1""",
    "a21_latencies": """select storage_provider, count(*) as samples, round(avg(elapsed_ms), 3) as mean_ms, arg_max(elapsed_ms, (sampled_at_ms, sample_no)) as last_ms
from ingest_samples where elapsed_ms > 0 group by 1""",
    "j4_media_partner": f"""with paths as (select asset_path as path from asset_hits where asset_path is not null union select asset_path from document_chunks where asset_path is not null
), keyed as (select path, {_STEM.format(p="path")} as stem, {_FOLDER.format(p="path")} as folder, {_EXT.format(p="path")} as ext from paths
), media as (select stem, folder, min(path) as partner from keyed where ext in ('mp4', 'mov', 'mkv', 'webm', 'm4v', 'jpg', 'jpeg', 'png', 'webp', 'gif', 'heic', 'avif') group by 1, 2)
select path, partner from keyed left join media using (stem, folder) where ext in ('md', 'mdx', 'txt', 'json', 'jsonl', 'csv', 'srt', 'vtt')""",
    "j5_preview_fallback": """with k as (select hit_key, max(hit_no) as n from asset_hits where batch_no <= 10 and hit_key is not null group by 1
), p as (select asset_path, segment_index, max(hit_no) as n from asset_hits where batch_no <= 10 group by 1, 2)
select h.hit_no, coalesce(k.n, p.n) as earlier_no from asset_hits h left join k on k.hit_key = h.hit_key
left join p on p.asset_path = h.asset_path and p.segment_index = h.segment_index where h.batch_no > 10""",
    "j15_already_stored": """select batch_no, count(*) as new_records from vector_records r
where batch_no = (select min(batch_no) from vector_records e where e.vec_key = r.vec_key) group by 1""",
    "d3_first_seen": "select asset_path, arg_min(hit_no, (batch_no, hit_no)) as hit_no from asset_hits where asset_path is not null group by 1",
    "q6_list_then_sort": """select hit_no, asset_path from (select * from asset_hits order by batch_no, hit_no limit 400)
order by case when not isnan(modified_at) then modified_at end desc nulls last, hit_no limit 100""",
    "q2_search_all": _WEB + """, local as (
  select hit_no as no, round(score, 6) as score, row_number() over (partition by case when file_kind = 'document' and not coalesce(legacy, false) then 'document:' || asset_path else hit_key end
    order by score desc, hit_no) as place from asset_hits where hit_key is not null and not isnan(score)
), seconds as (select record_no as no, (record_no % 101) / 101.0::double as s, row_number() over (partition by source_site, video_id, floor(start_seconds)
    order by (record_no % 101) / 101.0::double desc, record_no) as place from addressed
), united as (select no, score, 'local' as source from local where place = 1 union all select no, round(s, 6), 'web' from seconds where place = 1)
select no, score, source from united order by score desc, source, no limit 60""",
    "t7_library_order": """select library_root, count(distinct asset_path) as assets, cast(rank() over (order by count(distinct asset_path) desc) as integer) as place from asset_hits group by 1""",
    "u5_segments_known": """select asset_path, cast(count(distinct case when batch_no <= 10 then segment_index end) as integer) as early, cast(count(distinct case when batch_no > 10 then segment_index end) as integer) as late,
  cast(count(distinct segment_index) as integer) as either from asset_hits where asset_path is not null group by 1""",
    "x7_fan_out": """select item, coalesce(metadata.file_kind, '') as file_kind, count(*) as items from (
  select 'vector' as item, metadata from vector_records union all select 'title', metadata from vector_records where metadata.title <> '') group by 1, 2""",
    "s7_browse": """with files as (select distinct asset_path, string_split(regexp_replace(asset_path, '/[^/]*$', ''), '/') as p from asset_hits where asset_path like '/%'
), folders as (select array_to_string(p[1:n], '/') as child from files, range(2, 60) r(n) where n <= len(p))
select regexp_replace(child, '/[^/]*$', '') as parent, child, child in (select library_root from library_roots) as registered, count(*) as files from folders group by 1, 2""",
    "s19_sidecar_text": rf"""with paths as (select asset_path as path from asset_hits where asset_path is not null union select asset_path from document_chunks where asset_path is not null
), a as (select path, {_STEM.format(p="path")} as stem, {_FOLDER.format(p="path")} as folder, string_split({_FOLDER.format(p="path")}, '/') as parts from paths
), b as (select path, {_STEM.format(p="path")} as stem, {_FOLDER.format(p="path")} as folder, string_split({_FOLDER.format(p="path")}, '/') as parts from paths
  where {_EXT.format(p="path")} in ('txt', 'srt', 'vtt', 'md', 'json', 'csv')
), pairs as (select a.path, b.path as partner, a.folder <> b.folder as elsewhere,
    len(a.parts) + len(b.parts) - 2 * len(list_filter(range(1, least(len(a.parts), len(b.parts)) + 1), lambda n: a.parts[1:n] = b.parts[1:n])) as steps
  from a join b on a.stem = b.stem and a.path <> b.path
), best as (select * from pairs qualify row_number() over (partition by path order by elsewhere, steps, partner) = 1
), first as (select asset_path, arg_min(text, (chunk_index, chunk_no)) as text from document_chunks where text is not null group by 1)
select path, partner, cast(length(substr(trim(regexp_replace(text, '{_BLANK}+', ' ', 'g')), 1, 1120)) as integer) as characters from best left join first on asset_path = partner""",
}
