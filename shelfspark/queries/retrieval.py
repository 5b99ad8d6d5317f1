"""Queries over the vector store, top-k search, deduplication and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.functions.keys import collection_name
from shelfspark.functions.paths import extension
from shelfspark.functions.text import searchable_name
from shelfspark.functions.vectors import norm, shortened, usable
from shelfspark.operators import search, store
from shelfspark.sources.tables import table

SPACE = "lumo-embed-64-plain-shelf-v1"
NAMED = "demo csv PDF 街景 rough cut"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "vector_records")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "asset_hits")


def s1_vector_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one space and kind, without their vectors."""
    found = store.scan(_records(spark, sf_dir), F.col("metadata.embedding_space"), SPACE, store.metadata_filter({"file_kind": "video", "record_type": "asset", "title": " "}))
    return found.select("record_no", "vec_key", F.coalesce("metadata.title", F.lit("")).alias("title"), F.col("metadata.stored_at_ms").alias("stored_at_ms"))


def s2_vector_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by key in the order in which the keys were asked for; the keys are those of the records of images."""
    rows = _records(spark, sf_dir)
    asked = rows.where("metadata.file_kind = 'image'").select("vec_key", F.col("record_no").alias("order"))
    return store.lookup(rows, "vec_key", asked, "order").select("vec_key", "record_no", "asked_at")


def w3_pushdown_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per space, kind and site."""
    m = lambda f: F.coalesce(f"metadata.{f}", F.lit("")).alias(f)
    return _records(spark, sf_dir).groupBy(m("embedding_space"), m("file_kind"), m("source_site")).agg(F.count("*").alias("records"))


def w4_space_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every space that a read of one space gives, and what is left of them if the caller asks for any other space."""
    rows = _records(spark, sf_dir)
    space = F.col("metadata.embedding_space")
    read = store.scan(rows, space, SPACE).groupBy(space.alias("space")).agg(F.count("*").alias("records"), F.count_if(space != SPACE).alias("of_others"))
    every = rows.where(space.isNotNull()).groupBy(space.alias("space")).agg(F.count("*").alias("held"))
    return every.join(read, "space", "left").select("space", "held", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("of_others", F.lit(0)).alias("of_others"))


def k1_upsert_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index holds after all batches were written: the newest valid row of each key and space."""
    rows = _records(spark, sf_dir).where(F.col("vec_key").isNotNull() & usable(F.col("data_float32"), 64))
    newest = search.first_of(rows.withColumn("space", F.col("metadata.embedding_space")), ["vec_key", "space"], F.desc("batch_no"), F.desc("record_no"))
    return newest.select("vec_key", "space", "record_no")


def f9_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical collections of the records with their sizes."""
    space = F.coalesce("metadata.embedding_space", F.lit(""))
    named = collection_name(F.col("metadata.record_type"), space)
    return _records(spark, sf_dir).groupBy(named.alias("collection"), space.alias("space")).agg(F.count("*").alias("records"))


def f33_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each usable vector and of its first 32 values scaled to 1."""
    rows = _records(spark, sf_dir).where(usable(F.col("data_float32"), 64))
    return rows.select("record_no", F.round(norm(F.col("data_float32")), 5).alias("length"), F.round(norm(shortened(F.col("data_float32"), 32)), 5).alias("short_length"))


def t1_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 60 records of a space most similar to its first record."""
    rows = store.scan(_records(spark, sf_dir), F.col("metadata.embedding_space"), SPACE)
    query = rows.where(usable(F.col("data_float32"), 64)).orderBy("record_no").select("data_float32").first()
    if query is None:
        return rows.select("record_no", F.lit(0.0).alias("score")).limit(0)
    return search.top_k(rows, "data_float32", query[0], "record_no").select("record_no", F.round("score", 5).alias("score"))


def t1_multi_query_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of every vector whose id is divisible by 50, against all vectors."""
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_no"), F.lit("all").alias("space"), F.col("embedding").alias("vector"))
    return search.top_k_many(rows, "embedding", "vec_id", F.lit("all"), queries, 64, 10).withColumn("score", F.round("score", 5))


def d1_best_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hit per live document and per other hit key."""
    hits = _hits(spark, sf_dir).where("hit_key is not null and not isnan(score)")
    best = search.best_passage(hits, F.col("asset_path"), F.col("file_kind"), F.col("legacy"), F.col("hit_key"), F.col("score"), F.col("hit_no"))
    return best.select("hit_no", "asset_path", "score")


def d2_list_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per listed asset: documents by path, others by key; the newest, then the best, stays."""
    hits = _hits(spark, sf_dir).where("hit_key is not null")
    identity = F.when(F.col("file_kind") == "document", F.col("asset_path")).otherwise(F.col("hit_key"))
    newest = F.coalesce(F.when(~F.isnan("modified_at"), F.col("modified_at")), F.lit(0.0))
    return search.first_of(hits.withColumn("identity", identity), ["identity"], F.desc(newest), F.desc("score"), F.col("hit_no")).select("identity", "hit_no")


def d4_web_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per site, video and second of its storing time, its title filled from the others."""
    rows = _records(spark, sf_dir).where("metadata.video_id <> ''").select(
        "record_no",
        F.col("metadata.source_site").alias("site"),
        F.col("metadata.video_id").alias("video"),
        F.coalesce("metadata.title", F.lit("")).alias("title"),
        F.pmod("metadata.stored_at_ms", F.lit(7)).cast("double").alias("start"),
        (F.pmod("record_no", F.lit(97)) / 97.0).alias("score"),
        (F.col("metadata.record_type") != "asset").cast("int").alias("lane"),
    )
    best = search.web_dedupe(rows, F.col("site"), F.col("video"), F.col("start"), F.col("lane"), "score", "title", F.col("record_no"))
    return best.select("record_no", "site", "video", "title")


def t3_capped_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 60 best hits, of which legacy ones are half at most."""
    return search.capped_merge(_hits(spark, sf_dir).where("not isnan(score)"), "legacy", "score", 60, F.col("hit_no")).select("hit_no", "legacy", "score")


def t4_local_web_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 best of local hits and hits below network roots."""
    hits = _hits(spark, sf_dir).where("not isnan(score)").select("hit_no", "asset_path", "score")
    web = F.startswith("asset_path", F.lit("/srv/"))
    return search.merged_sources(hits.where(~web), hits.where(web), "score", 100, F.col("hit_no"))


def t5_asset_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 newest hits, by path where times are equal."""
    known = F.when(F.isnan("modified_at"), None).otherwise(F.col("modified_at"))
    return _hits(spark, sf_dir).orderBy(F.desc_nulls_last(known), "asset_path", "hit_no").limit(500).select("hit_no", "asset_path", "modified_at")


def t10_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of twelve hits by score."""
    return search.page_of(_hits(spark, sf_dir).where("not isnan(score)"), 3, 12, F.desc("score"), F.col("hit_no")).select("hit_no", "score")


def f4_lexical_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits whose file name or format a query names, with the lift and the lifted score."""
    hits = _hits(spark, sf_dir).where("not isnan(score)").select("hit_no", "asset_name", "score")
    lifted = search.with_lexical_boost(hits, F.lit(NAMED), "asset_name", extension(F.col("asset_name")), "score")
    return lifted.where("boost > 0").select("hit_no", F.round("boost", 6).alias("boost"), F.round("score", 6).alias("score"))


def f3_searchable_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searchable form of every asset name."""
    return _hits(spark, sf_dir).select("hit_no", searchable_name(F.col("asset_name")).alias("searchable"))


def r1_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 best hits after a reranker rated every third of the first 20 by their file size."""
    hits = _hits(spark, sf_dir).where("not isnan(score)").orderBy(F.desc("score"), "hit_no").limit(100)
    placed = hits.withColumn("position", F.row_number().over(W.orderBy(F.desc("score"), "hit_no")) - 1)  # 100 rows
    rated = placed.where("position % 3 = 0 and position < 20").select("position", F.col("file_size").cast("double").alias("relevance"))
    ranked = search.reranked(placed, "position", rated)
    return ranked.select("hit_no", "position", "part", "relevance")


def q1_asset_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search from recall to result: lanes by kind, best passage per document, gone files out, lexical lift, capped merge."""
    hits = _hits(spark, sf_dir).where("hit_key is not null and not isnan(score)")
    lane = F.when(F.coalesce("legacy", F.lit(False)), "legacy").when(F.col("file_kind") == "document", "text").otherwise("visual")
    united = search.best_per_lane(hits.withColumn("lane", lane), F.col("lane"), "score", 500, F.col("hit_no"))
    best = search.best_passage(united, F.col("asset_path"), F.col("file_kind"), F.col("legacy"), F.col("hit_key"), F.col("score"), F.col("hit_no"))
    alive = _hits(spark, sf_dir).where("batch_no > 10").select("asset_path").distinct()
    live = best.join(alive, "asset_path", "left_semi")
    lifted = search.with_lexical_boost(live, F.lit(NAMED), "asset_name", extension(F.col("asset_name")), "score")
    return search.capped_merge(lifted.withColumn("score", F.round("score", 6)), "legacy", "score", 50, F.col("hit_no")).select("hit_no", "lane", "score")


QUERIES = {
    f.__name__: f
    for f in (
        s1_vector_scan, s2_vector_lookup, w3_pushdown_counts, w4_space_isolation, k1_upsert_newest, f9_collections, f33_norms, t1_vector_topk,
        t1_multi_query_topk, d1_best_passage, d2_list_dedupe, d4_web_dedupe, t3_capped_merge, t4_local_web_merge, t5_asset_list, t10_page,
        f4_lexical_boost, f3_searchable_name, r1_rerank, q1_asset_search,
    )
}

_USABLE = "len({v}) = 64 and len(list_filter({v}, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter({v}, lambda x: x <> 0)) > 0"
_SEARCHABLE = r"trim(regexp_replace(regexp_replace(lower(nfc_normalize({n})), '\.[a-z0-9]{{1,8}}$', ''), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
BOOSTED = (
    """
named as (select *, """
    + _SEARCHABLE.format(n="asset_name")
    + " as own, "
    + _SEARCHABLE.format(n=f"'{NAMED}'")
    + r""" as wanted, lower(regexp_extract(asset_name, '\.([^./\\]+)$', 1)) as ext from {rows}
), tokens as (
  select *, list_filter(string_split(own, ' '), lambda t: length(t) >= 2) as parts from named
), matches as (
  select *, len(list_filter(parts, lambda t: contains(wanted, t))) as matched from tokens
), lifted as (
  select *, case when own = '' or wanted = '' then 0.0 else least(0.22,
    case when contains(wanted, own) then 0.18 when matched > 0 then least(0.12, 0.04 + 0.08 * matched / greatest(len(parts), 1)) else 0.0 end
    + case when ext in ('csv', 'pdf') then 0.14 else 0.0 end) end as boost from matches
)"""
)

ORACLES = {
    "s1_vector_scan": f"""select record_no, vec_key, coalesce(metadata.title, '') as title, metadata.stored_at_ms as stored_at_ms
from vector_records where metadata.embedding_space = '{SPACE}' and metadata.file_kind = 'video' and metadata.record_type = 'asset'""",
    "s2_vector_lookup": """select r.vec_key, r.record_no, a.asked_at from vector_records r
join (select vec_key, min(record_no) as asked_at from vector_records where metadata.file_kind = 'image' and vec_key <> '' group by 1) a using (vec_key)""",
    "w3_pushdown_counts": """select coalesce(metadata.embedding_space, '') as embedding_space, coalesce(metadata.file_kind, '') as file_kind,
coalesce(metadata.source_site, '') as source_site, count(*) as records from vector_records group by 1, 2, 3""",
    "w4_space_isolation": f"""select metadata.embedding_space as space, count(*) as held, count(*) filter (where metadata.embedding_space = '{SPACE}') as records,
  cast(0 as bigint) as of_others from vector_records where metadata.embedding_space is not null group by 1""",
    "k1_upsert_newest": f"""select vec_key, space, record_no from (
  select *, metadata.embedding_space as space, row_number() over (partition by vec_key, metadata.embedding_space order by batch_no desc, record_no desc) as place
  from vector_records where vec_key is not null and {_USABLE.format(v="data_float32")}) where place = 1""",
    "f9_collections": """select 'v2_' || substr(regexp_replace(metadata.record_type, '[^A-Za-z0-9_]+', '_', 'g'), 1, 24) || '_'
  || sha256(metadata.record_type || chr(31) || coalesce(metadata.embedding_space, '')) as collection,
  coalesce(metadata.embedding_space, '') as space, count(*) as records from vector_records group by 1, 2""",
    "f33_norms": f"""select record_no, round(sqrt(list_sum(list_transform(data_float32, lambda x: x::double * x::double))), 5) as length,
  case when list_sum(list_transform(data_float32[1:32], lambda x: x::double * x::double)) > 0 then 1.0::double else 0.0::double end as short_length
from vector_records where {_USABLE.format(v="data_float32")}""",
    "t1_vector_topk": f"""with rows as (
  select record_no, data_float32::double[] as v from vector_records where metadata.embedding_space = '{SPACE}' and {_USABLE.format(v="data_float32")}
), query as (select v as q from rows order by record_no limit 1)
select record_no, round(list_cosine_similarity(v, q), 5) as score from rows, query order by list_cosine_similarity(v, q) desc, record_no limit 60""",
    "t1_multi_query_topk": """with v as (select vec_id, embedding::double[] as e from embeddings), scored as (
  select a.vec_id as query_no, b.vec_id as neighbour_no, list_cosine_similarity(a.e, b.e) as s from v a, v b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
), ranked as (select *, row_number() over (partition by query_no order by round(s, 9) desc, neighbour_no) as rank from scored)
select query_no, cast(rank as integer) as rank, neighbour_no, round(s, 5) as score from ranked where rank <= 10""",
    "d1_best_passage": """select hit_no, asset_path, score from (
  select *, row_number() over (partition by case when file_kind = 'document' and not coalesce(legacy, false) then 'document:' || asset_path else hit_key end
    order by score desc, hit_no) as place from asset_hits where hit_key is not null and not isnan(score)) where place = 1""",
    "d2_list_dedupe": """select identity, hit_no from (
  select *, case when file_kind = 'document' then asset_path else hit_key end as identity, row_number() over (
    partition by case when file_kind = 'document' then asset_path else hit_key end
    order by coalesce(case when not isnan(modified_at) then modified_at end, 0) desc, score desc, hit_no) as place
  from asset_hits where hit_key is not null) where place = 1""",
    "d4_web_dedupe": """with rows as (
  select record_no, metadata.source_site as site, metadata.video_id as video, coalesce(metadata.title, '') as title,
    floor((metadata.stored_at_ms % 7)::double) as second, (record_no % 97) / 97.0::double as score, case when metadata.record_type <> 'asset' then 1 else 0 end as lane
  from vector_records where metadata.video_id <> ''
), keyed as (select *, coalesce(nullif(site, ''), 'youtube') as s from rows), ranked as (
  select *, row_number() over (partition by s, video, second order by score desc, lane, record_no) as place,
    first_value(nullif(title, '') ignore nulls) over (partition by s, video, second order by lane, record_no rows between unbounded preceding and unbounded following) as held
  from keyed)
select record_no, site, video, coalesce(nullif(title, ''), held, '') as title from ranked where place = 1""",
    "t3_capped_merge": """with ranked as (
  select hit_no, legacy, score, row_number() over (partition by coalesce(legacy, false) order by score desc, hit_no) as place from asset_hits where not isnan(score))
select hit_no, legacy, score from ranked where not coalesce(legacy, false) or place <= 30 order by score desc, coalesce(legacy, false), hit_no limit 60""",
    "t4_local_web_merge": """select hit_no, asset_path, score, case when starts_with(asset_path, '/srv/') then 'web' else 'local' end as source
from asset_hits where not isnan(score) and asset_path is not null order by score desc, 4, hit_no limit 100""",
    "t5_asset_list": """select hit_no, asset_path, modified_at from asset_hits
order by case when isnan(modified_at) then null else modified_at end desc nulls last, asset_path, hit_no limit 500""",
    "t10_page": "select hit_no, score from asset_hits where not isnan(score) order by score desc, hit_no limit 12 offset 24",
    "f4_lexical_boost": "with " + BOOSTED.replace("{rows}", "asset_hits where not isnan(score)") + """
select hit_no, round(boost, 6) as boost, round(greatest(score, least(1.0, score + boost)), 6) as score from lifted where boost > 0""",
    "f3_searchable_name": "select hit_no, " + _SEARCHABLE.format(n="asset_name") + " as searchable from asset_hits",
    "r1_rerank": """with hits as (select hit_no, file_size, row_number() over (order by score desc, hit_no) - 1 as position from asset_hits where not isnan(score)
  qualify position < 100)
select hit_no, cast(position as integer) as position, case when position % 3 = 0 and position < 20 then 0 when position < 20 then 1 else 2 end as part,
  case when position % 3 = 0 and position < 20 then file_size::double end as relevance from hits""",
    "q1_asset_search": """with recall as (
  select *, case when coalesce(legacy, false) then 'legacy' when file_kind = 'document' then 'text' else 'visual' end as lane
  from asset_hits where hit_key is not null and not isnan(score)
), lanes as (select *, row_number() over (partition by lane order by score desc, hit_no) as in_lane from recall qualify in_lane <= 500
), best as (select *, row_number() over (partition by case when file_kind = 'document' and not coalesce(legacy, false) then 'document:' || asset_path else hit_key end
    order by score desc, hit_no) as passage from lanes qualify passage = 1
), live as (select * from best where asset_path in (select asset_path from asset_hits where batch_no > 10)
), """ + BOOSTED.replace("{rows}", "live") + """, scored as (select hit_no, lane, coalesce(legacy, false) as old, round(greatest(score, least(1.0, score + boost)), 6) as score from lifted
), capped as (select *, row_number() over (partition by old order by score desc, hit_no) as place from scored qualify not old or place <= 25)
select hit_no, lane, score from capped order by score desc, old, hit_no limit 50""",
}
