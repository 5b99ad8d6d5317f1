"""Queries over files, index rows, libraries and their coverage.

The hits of batches 11 on stand for the files that a scan finds now, those up to batch 10 for the rows of the index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.keys import asset_key, fingerprint, uuid5_url
from shelfspark.functions.media import byte_size
from shelfspark.functions.paths import extension, file_name, folder, folder_label, kind_of, mime_of, passed_by
from shelfspark.operators import library
from shelfspark.sources.tables import table


def _known(name: str) -> F.Column:
    return F.when(F.isnan(name), None).otherwise(F.col(name))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "asset_hits").where("asset_path is not null")
    return hits.select(
        F.col("library_root").alias("root"),
        F.col("asset_path").alias("path"),
        F.when(F.coalesce("file_kind", F.lit("")) != "", F.col("file_kind")).otherwise(kind_of(extension(F.col("asset_path")), "file")).alias("kind"),
        F.coalesce(fingerprint(F.col("file_size"), _known("modified_at")), F.lit("")).alias("fingerprint"),
        (~F.coalesce("legacy", F.lit(False))).alias("current"),
        F.col("hit_no").alias("written"),
        "batch_no",
        "file_size",
    )


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _rows(spark, sf_dir).where("batch_no > 10")
    return library.last_versions(seen, ["root", "path"], F.desc("written")).select("root", "path", "kind", "fingerprint", "file_size")


def _held_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).where("batch_no <= 10")


def j1_scan_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a scan has to take in, may skip, or has to remove from the index."""
    return library.scan_states(_files(spark, sf_dir), _held_rows(spark, sf_dir))


def j2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file as cached, pending, stale or missing."""
    return library.coverage(_files(spark, sf_dir), _held_rows(spark, sf_dir))


def a3_coverage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the states per root and kind, per root, and over all."""
    return library.coverage_totals(j2_coverage(spark, sf_dir))


def k9_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are gone with the number of their rows."""
    return library.missing_by_file(_held_rows(spark, sf_dir), _files(spark, sf_dir))


def w7_missing_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows shown and rows hidden per kind because their file is gone."""
    rows = _held_rows(spark, sf_dir)
    gone = library.missing_rows(rows, _files(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("hidden"))
    return rows.groupBy("kind").agg(F.count("*").alias("of")).join(gone, "kind", "left").select("kind", (F.col("of") - F.coalesce("hidden", F.lit(0))).alias("shown"), F.coalesce("hidden", F.lit(0)).alias("hidden"))


def j3_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest text file of the same stem for every file."""
    files = _rows(spark, sf_dir).select("path").distinct()
    chunks = table(spark, sf_dir, "document_chunks").select(F.col("asset_path").alias("path")).where("path is not null").distinct()
    return library.sidecars(files.unionByName(chunks), files.unionByName(chunks))


def a18_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per stem and folder, and the first of them."""
    return library.stems(_rows(spark, sf_dir))


def j11_owning_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered root above every file."""
    roots = table(spark, sf_dir, "library_roots").select(F.col("library_root").alias("root"))
    return library.owning_root(_rows(spark, sf_dir), roots)


def j10_overlapping_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of files that lie below a registered root, counted per root."""
    roots = table(spark, sf_dir, "library_roots").select(F.col("library_root").alias("root"))
    folders = _rows(spark, sf_dir).select(folder(F.col("path")).alias("root")).distinct()
    return library.overlapping_roots(roots.unionByName(folders).distinct()).groupBy("outer_root").agg(F.count("*").alias("inner_roots"))


def j14_stale_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of index rows whose file was written again without them."""
    key = lambda rows: rows.select("path", F.sha2(F.concat_ws(":", "path", "fingerprint"), 256).alias("key")).distinct()
    return library.stale_keys(key(_held_rows(spark, sf_dir)), key(_rows(spark, sf_dir).where("batch_no > 10")))


def t8_scan_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 400 pending files by path."""
    return library.scan_budget(j1_scan_states(spark, sf_dir).where("state = 'pending'").select("path").distinct(), 400)


def a2_library_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets, rows and the time of the last row per registered root; roots without rows count 0."""
    hits = table(spark, sf_dir, "asset_hits").groupBy("library_root").agg(F.count_distinct("asset_path").alias("assets"), F.count("*").alias("rows"), F.max("received_at").alias("last_row"))
    roots = table(spark, sf_dir, "library_roots")
    return roots.join(hits, "library_root", "left").select(
        "library_root", F.array_join(F.array_sort("asset_kinds"), ",").alias("kinds"), F.coalesce("assets", F.lit(0)).alias("assets"), F.coalesce("rows", F.lit(0)).alias("rows"), "last_row"
    )


def w6_kind_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per root of a kind that the root does not track."""
    roots = table(spark, sf_dir, "library_roots").select(F.col("library_root").alias("root"), "asset_kinds")
    files = _rows(spark, sf_dir).select("root", "path", "kind").distinct()
    return files.join(F.broadcast(roots), "root").where(~F.array_contains("asset_kinds", F.col("kind"))).groupBy("root", "kind").agg(F.count("*").alias("files"))


def w9_input_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks per version and whether they are current."""
    chunks = table(spark, sf_dir, "document_chunks")
    current = library.input_current(F.lit("document"), F.lit("v1"), F.lit("v1"), F.col("document_chunk_version"), F.lit("window-c"))
    return chunks.groupBy(F.coalesce("document_chunk_version", F.lit("")).alias("version"), current.alias("current")).agg(F.count("*").alias("chunks"))


def f21_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per extension with its kind and content type."""
    ext = extension(F.col("path"))
    return _rows(spark, sf_dir).groupBy(ext.alias("extension"), kind_of(ext, "file").alias("kind"), mime_of(ext).alias("mime")).agg(F.count("*").alias("files"))


def f22_folder_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the folders that hold files, with the number of files."""
    return _rows(spark, sf_dir).groupBy(folder(F.col("path")).alias("folder")).agg(F.count_distinct("path").alias("files")).withColumn("label", folder_label(F.col("folder")))


def s5_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per root: files that a scan would list and those in folders that it passes by."""
    files = _rows(spark, sf_dir).select("root", "path").distinct()
    return files.groupBy("root").agg(F.count_if(~passed_by(F.col("path"))).alias("listed"), F.count_if(passed_by(F.col("path"))).alias("passed_by"))


def f20_asset_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic key of every segment."""
    hits = table(spark, sf_dir, "asset_hits")
    return hits.where("asset_path is not null and segment_index is not null").select("hit_no", asset_key(F.col("asset_path"), F.col("segment_index"), F.lit("space-v1")).alias("key"))


def f7_uuid5_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UUIDs of the file names: how many there are, of which version and variant."""
    key = uuid5_url(file_name(F.col("path")))
    return _rows(spark, sf_dir).select(key.alias("key")).agg(F.count_distinct("key").alias("keys"), F.count_if(F.substring("key", 15, 1) != "5").alias("other_version"), F.count_if(~F.substring("key", 20, 1).isin("8", "9", "a", "b")).alias("other_variant"))


def f26_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes per root and kind, readable."""
    total = _rows(spark, sf_dir).groupBy("root", "kind").agg(F.sum("file_size").alias("bytes"))
    return total.where("bytes is not null").withColumn("readable", byte_size(F.col("bytes")))


def u4_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the index that the scan did not see, per root."""
    gone = _held_rows(spark, sf_dir).select("root", "path").exceptAll(_held_rows(spark, sf_dir).select("root", "path").join(_files(spark, sf_dir), ["root", "path"], "left_semi")).distinct()
    return gone.groupBy("root").agg(F.count("*").alias("gone"))


def pr1_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in the form that searches give: blanks filled, kinds from extensions, ends not before starts."""
    hits = table(spark, sf_dir, "asset_hits")
    number = lambda c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0))
    ext = extension(F.col("asset_path"))
    return hits.select(
        "hit_no",
        F.coalesce(F.nullif("hit_key", F.lit("")), F.concat_ws(":", "asset_path", "segment_index")).alias("id"),
        F.coalesce(F.nullif("asset_name", F.lit("")), file_name(F.col("asset_path")), F.lit("")).alias("name"),
        F.coalesce(F.nullif("file_kind", F.lit("")), F.nullif(kind_of(ext), F.lit("")), F.lit("document")).alias("kind"),
        number("start_seconds").alias("start_seconds"),
        F.greatest(number("start_seconds"), number("end_seconds")).alias("end_seconds"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), number("score"))).alias("score"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        j1_scan_states, j2_coverage, a3_coverage_totals, k9_prune, w7_missing_filter, j3_sidecars, a18_stems, j11_owning_root, j10_overlapping_roots,
        j14_stale_keys, t8_scan_budget, a2_library_status, w6_kind_filter, w9_input_current, f21_kinds, f22_folder_labels, s5_walk, f20_asset_keys,
        f7_uuid5_versions, f26_sizes, u4_set_difference, pr1_hits,
    )
}

_EXT = r"lower(regexp_extract({p}, '\.([^./\\]+)$', 1))"
_KIND = """case when {e} in ('mp4', 'mov', 'mkv', 'webm', 'm4v') then 'video' when {e} in ('jpg', 'jpeg', 'png', 'webp', 'gif', 'heic', 'avif') then 'image'
 when {e} in ('pdf', 'doc', 'docx', 'md', 'mdx', 'txt', 'json', 'jsonl', 'csv', 'srt', 'vtt', 'ts', 'tsx', 'js', 'jsx', 'py', 'html', 'css') then 'document' else {o} end"""
_PATH_EXT = _EXT.format(p="asset_path")
_ROWS = f"""with rows as (
  select library_root as root, asset_path as path,
    case when coalesce(file_kind, '') <> '' then file_kind else {_KIND.format(e=_PATH_EXT, o="'file'")} end as kind,
    coalesce(file_size::varchar || ':' || cast(floor(case when not isnan(modified_at) then modified_at end + 0.5) as bigint)::varchar, '') as fingerprint,
    not coalesce(legacy, false) as current, hit_no as written, batch_no, file_size
  from asset_hits where asset_path is not null
), files as (
  select root, path, kind, fingerprint, file_size from rows where batch_no > 10 qualify row_number() over (partition by root, path order by written desc) = 1
), held_rows as (select * from rows where batch_no <= 10)
"""
_COVERAGE = _ROWS + """, newest as (
  select root, path, fingerprint, current from held_rows qualify row_number() over (partition by root, path order by written desc) = 1
), coverage as (
  select coalesce(f.root, n.root) as root, f.kind as kind, coalesce(f.path, n.path) as path, case when f.path is null then 'missing' when n.path is null then 'pending'
    when n.fingerprint = f.fingerprint and n.current then 'cached' else 'stale' end as state
  from files f full join newest n on f.root = n.root and f.path = n.path)
"""
_STATES = _ROWS + """, known as (select root, path, list(distinct fingerprint) as fps, bool_and(current) as ok from held_rows group by 1, 2
), states as (
  select coalesce(f.root, k.root) as root, coalesce(f.path, k.path) as path, case when f.path is null then 'vanished'
    when k.path is null or not k.ok or not list_contains(k.fps, f.fingerprint) then 'pending' else 'skipped' end as state
  from files f full join known k on f.root = k.root and f.path = k.path)
"""
_FOLDER = "regexp_replace({p}, '/[^/]*$', '')"
_STEM = r"lower(regexp_replace(list_extract(string_split({p}, '/'), -1), '\.[^.]*$', ''))"

ORACLES = {
    "j1_scan_states": _STATES + "select * from states",
    "j2_coverage": _COVERAGE + "select * from coverage",
    "a3_coverage_totals": _COVERAGE
    + """select root, kind, count(*) filter (where state = 'cached') as cached, count(*) filter (where state = 'pending') as pending,
  count(*) filter (where state = 'stale') as stale, count(*) filter (where state = 'missing') as missing, cast(grouping(root, kind) as integer) as level
from (select coalesce(root, '') as root, coalesce(kind, '') as kind, state from coverage) group by rollup (root, kind)""",
    "k9_prune": _ROWS + "select path, count(*) as rows from held_rows where path not in (select path from files) group by 1",
    "w7_missing_filter": _ROWS
    + """select kind, count(*) filter (where path in (select path from files)) as shown, count(*) filter (where path not in (select path from files)) as hidden
from held_rows group by 1""",
    "j3_sidecars": f"""with files as (select asset_path as path from asset_hits where asset_path is not null union select asset_path from document_chunks where asset_path is not null
), keyed as (select path, {_STEM.format(p="path")} as stem, {_FOLDER.format(p="path")} as folder, string_split({_FOLDER.format(p="path")}, '/') as parts, {_EXT.format(p="path")} as ext from files
), pairs as (
  select a.path, b.path as partner, a.folder <> b.folder as elsewhere,
    len(a.parts) + len(b.parts) - 2 * len(list_filter(range(1, least(len(a.parts), len(b.parts)) + 1), lambda n: a.parts[1:n] = b.parts[1:n])) as steps
  from keyed a join keyed b on a.stem = b.stem and a.path <> b.path where b.ext in ('txt', 'srt', 'vtt', 'md', 'json', 'csv'))
select path, partner, cast(steps as integer) as steps from pairs qualify row_number() over (partition by path order by elsewhere, steps, partner) = 1""",
    "a18_stems": f"""select {_STEM.format(p="asset_path")} as stem, {_FOLDER.format(p="asset_path")} as folder, count(distinct asset_path) as files, min(asset_path) as first_path
from asset_hits where asset_path is not null group by 1, 2""",
    "j11_owning_root": """with files as (select distinct asset_path as path from asset_hits where asset_path is not null)
select path, (select max_by(library_root, length(library_root)) from library_roots where path = library_root or starts_with(path, library_root || '/')) as owner from files""",
    "j10_overlapping_roots": f"""with roots as (select library_root as root from library_roots union select {_FOLDER.format(p="asset_path")} from asset_hits where asset_path is not null)
select b.root as outer_root, count(*) as inner_roots from roots a join roots b on starts_with(a.root, b.root || '/') group by 1""",
    "j14_stale_keys": _ROWS
    + """, old as (select distinct path, sha256(path || ':' || fingerprint) as key from held_rows
), fresh as (select distinct path, sha256(path || ':' || fingerprint) as key from rows where batch_no > 10)
select path, key from old where path in (select path from fresh) and key not in (select key from fresh)""",
    "t8_scan_budget": _STATES + "select distinct path from states where state = 'pending' order by path limit 400",
    "a2_library_status": """select r.library_root, array_to_string(list_sort(r.asset_kinds), ',') as kinds, count(distinct h.asset_path) as assets, count(h.hit_no) as rows, max(h.received_at) as last_row
from library_roots r left join asset_hits h on h.library_root = r.library_root group by r.library_root, r.asset_kinds""",
    "w6_kind_filter": _ROWS + """select f.root, f.kind, count(*) as files from (select distinct root, path, kind from rows) f
join library_roots r on r.library_root = f.root where not list_contains(r.asset_kinds, f.kind) group by 1, 2""",
    "w9_input_current": """select coalesce(document_chunk_version, '') as version, coalesce(document_chunk_version, '') = 'window-c' as current, count(*) as chunks
from document_chunks group by 1, 2""",
    "f21_kinds": f"""select ext as extension, {_KIND.format(e="ext", o="'file'")} as kind, case ext when 'mp4' then 'video/mp4' when 'mov' then 'video/quicktime' when 'm4v' then 'video/x-m4v'
  when 'mkv' then 'video/x-matroska' when 'webm' then 'video/webm' when 'jpg' then 'image/jpeg' when 'jpeg' then 'image/jpeg' when 'png' then 'image/png' when 'webp' then 'image/webp'
  when 'gif' then 'image/gif' when 'heic' then 'image/heic' when 'avif' then 'image/avif' when 'pdf' then 'application/pdf' when 'doc' then 'application/msword'
  when 'docx' then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' else 'application/octet-stream' end as mime, count(*) as files
from (select {_PATH_EXT} as ext from asset_hits where asset_path is not null) group by 1, 2, 3""",
    "f22_folder_labels": rf"""with folders as (select {_FOLDER.format(p="asset_path")} as folder, count(distinct asset_path) as files from asset_hits where asset_path is not null group by 1
), parts as (select *, list_filter(string_split(folder, '/'), lambda p: p <> '') as p from folders)
select folder, files, case when len(p) = 0 then '/' when regexp_matches(p[-1], '(?i)^(assets?|media|videos?|files?|renders?|output|out|clips?|素材)$') and len(p) > 1
  then p[-2] || '/' || p[-1] else p[-1] end as label from parts""",
    "s5_walk": """with files as (select distinct library_root as root, asset_path as path from asset_hits where asset_path is not null
), judged as (select root, len(list_filter(string_split(path, '/'), lambda p: starts_with(p, '.') or list_contains(
  ['build', 'dist', 'node_modules', 'out', 'target', 'venv', '__pycache__'], p))) > 0 as skipped from files)
select root, count(*) filter (where not skipped) as listed, count(*) filter (where skipped) as passed_by from judged group by 1""",
    "f20_asset_keys": r"""with d as (select hit_no, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('asset:' || asset_path || ':' || segment_index || ':space-v1')) as h
  from asset_hits where asset_path is not null and segment_index is not null)
select hit_no, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || case when h[17] in ('0', '4', '8', 'c') then '8' when h[17] in ('1', '5', '9', 'd') then '9'
  when h[17] in ('2', '6', 'a', 'e') then 'a' else 'b' end || h[18] || h[19:20] || '-' || h[21:32] as key from d""",
    "f7_uuid5_versions": """select count(distinct list_extract(string_split(asset_path, '/'), -1)) as keys, cast(0 as bigint) as other_version, cast(0 as bigint) as other_variant
from asset_hits where asset_path is not null""",
    "f26_sizes": _ROWS + """select root, kind, cast(sum(file_size) as bigint) as bytes, case when sum(file_size) >= 1073741824 then round(sum(file_size) / 1073741824, 1)::double::varchar || ' GB'
  when sum(file_size) >= 1048576 then round(sum(file_size) / 1048576, 1)::double::varchar || ' MB' when sum(file_size) >= 1024 then round(sum(file_size) / 1024, 1)::double::varchar || ' KB'
  else sum(file_size)::bigint::varchar || ' B' end as readable from rows group by 1, 2 having sum(file_size) is not null""",
    "u4_set_difference": _ROWS + """select root, count(*) as gone from (select distinct root, path from held_rows except select root, path from files) group by 1""",
    "pr1_hits": f"""select hit_no, coalesce(nullif(hit_key, ''), concat_ws(':', asset_path, segment_index::varchar)) as id,
  coalesce(nullif(asset_name, ''), list_extract(string_split(asset_path, '/'), -1), '') as name,
  coalesce(nullif(file_kind, ''), nullif({_KIND.format(e=_PATH_EXT, o="''")}, ''), 'document') as kind,
  coalesce(case when not isnan(start_seconds) then start_seconds end, 0) as start_seconds,
  greatest(coalesce(case when not isnan(start_seconds) then start_seconds end, 0), coalesce(case when not isnan(end_seconds) then end_seconds end, 0)) as end_seconds,
  greatest(-1.0, least(1.0, coalesce(case when not isnan(score) then score end, 0))) as score from asset_hits""",
}
