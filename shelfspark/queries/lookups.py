"""Searches by a vector through all steps, writes to the store, a scan, deletion tokens and fitting previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.functions.keys import set_token
from shelfspark.functions.paths import extension
from shelfspark.functions.plugins import HashEmbedder
from shelfspark.functions.text import preview
from shelfspark.functions.vectors import cosine, usable
from shelfspark.operators import search, store
from shelfspark.plans.scan import scan
from shelfspark.queries.retrieval import BOOSTED, NAMED, SPACE
from shelfspark.sources.tables import table

#: Best rows of a lane that the later steps see, and rows of the answer.
RECALL, ANSWER = 200, 60
METADATA_BYTES = 120


def _own(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "vector_records")
    return store.scan(rows, F.col("metadata.embedding_space"), SPACE, usable(F.col("data_float32"), 64)).select("record_no", "batch_no", "vec_key", "data_float32", "metadata.*")


def q3_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the vector of an image to the answer: recall per lane, one row per file, files that are still there, lift by name.

    The query is the vector of the first record of an image. The lanes are the record types; a row is the best of its file
    or, where it has none, of its key.
    """
    rows = _own(spark, sf_dir)
    query = rows.where("file_kind = 'image'").orderBy("record_no").select("data_float32").first()
    if query is None:
        return rows.select("record_no", F.lit("").alias("record_type"), F.lit(0.0).alias("score")).limit(0)
    wanted = F.array(*[F.lit(float(x)) for x in query[0]])
    scored = rows.select("record_no", "record_type", "vec_key", "asset_path", "title", F.round(cosine(F.col("data_float32"), wanted), 9).alias("score"))
    lanes = search.best_per_lane(scored, F.coalesce("record_type", F.lit("")), "score", RECALL, F.col("record_no"))
    named = lanes.withColumn("file", F.coalesce(F.nullif("asset_path", F.lit("")), F.concat(F.lit("key:"), F.col("vec_key"))))
    best = search.first_of(named, ["file"], F.desc("score"), F.col("record_no"))
    gone = table(spark, sf_dir, "asset_hits").where("file_kind = 'document'").select(F.col("asset_path").alias("file")).distinct()
    there = best.join(gone, "file", "left_anti").withColumn("title", F.coalesce("title", F.lit("")))
    lifted = search.with_lexical_boost(there, F.lit(NAMED), "title", extension(F.col("title")), "score")
    return lifted.orderBy(F.desc(F.round("score", 6)), "record_no").limit(ANSWER).select("record_no", "record_type", F.round("score", 6).alias("score"))


def q4_video_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The videos most like each video: their mean vectors, compared with all records of other videos, the best record per video."""
    rows = _own(spark, sf_dir).where("video_id <> ''")
    mean = F.array(*[F.avg(F.col("data_float32")[k].cast("double")) for k in range(64)])
    queries = rows.groupBy("video_id").agg(mean.alias("vector"), F.min("record_no").alias("query_no"), F.max(F.when(F.col("record_no") % 50 == 0, 1)).alias("asked")).where("asked = 1")
    found = search.top_k_many(rows, "data_float32", "record_no", F.lit("all"), queries.select("query_no", F.lit("all").alias("space"), "vector"), 64, 60)
    named = found.join(rows.select(F.col("record_no").alias("neighbour_no"), F.col("video_id").alias("found_video")), "neighbour_no").join(queries.select("query_no", "video_id"), "query_no").where("found_video <> video_id")
    best = named.groupBy("video_id", "found_video").agg(F.max(F.round("score", 5)).alias("score"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("score"), "found_video"))).where("rank <= 5").select("video_id", "rank", "found_video", "score")


def k3_store_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store holds after two upserts, the later half of the batches over the earlier one, and the deletion of images."""
    rows = _own(spark, sf_dir).where("vec_key is not null and vec_key <> ''")
    held = store.VectorStore(spark)
    for half in ("batch_no <= 10", "batch_no > 10"):
        newest = search.first_of(rows.where(half), ["vec_key"], F.desc("batch_no"), F.desc("record_no"))
        made = F.create_map(F.lit("kind"), F.coalesce("file_kind", F.lit("")), F.lit("record_no"), F.col("record_no").cast("string"))
        held.upsert("records", SPACE, newest.select(F.col("vec_key").alias("key"), F.col("data_float32").alias("vector"), made.alias("metadata"), F.col("record_no").alias("written_ms")))
    held.purge("records", SPACE, F.col("metadata.kind") == "image")
    return held.read("records", SPACE).select(F.col("key").alias("vec_key"), F.col("metadata.record_no").cast("long").alias("record_no"))


def x1_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document in the store after a scan took all of them in."""
    documents = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").cast("string").alias("path"), "text").dropDuplicates(["path"])
    files = documents.select(F.lit("docs").alias("root"), "path", F.md5(F.coalesce("text", F.lit(""))).alias("fingerprint"))
    held = store.VectorStore(spark)
    scan(held, "documents", SPACE, "docs", files, documents, HashEmbedder(16), most_files=2_000_000_000)
    return held.files("documents", SPACE).select("path", "has_text", "chunks", "vectors")


def k8_deletion_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per video: its keys counted, and a token that changes if any key comes or goes."""
    rows = table(spark, sf_dir, "vector_records").where("metadata.video_id <> '' and vec_key is not null").select(F.col("metadata.video_id").alias("video"), "vec_key").distinct()
    return rows.groupBy("video").agg(F.count("*").alias("keys"), set_token(F.col("vec_key")).alias("token"))


def k17_fitting_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose preview fits into the bytes of a row's metadata beside path and root; the others keep none."""
    shown = preview(F.col("text"), 100)
    rows = table(spark, sf_dir, "document_chunks").where("text is not null and asset_path is not null and library_root is not null").select("chunk_no", shown.alias("preview"), F.octet_length("asset_path").alias("a"), F.octet_length("library_root").alias("b"))
    fits = F.col("a") + F.col("b") + F.octet_length("preview") <= METADATA_BYTES
    return rows.select("chunk_no", F.when(fits, F.col("preview")).alias("preview"))


QUERIES = {f.__name__: f for f in (q3_vector_search, q4_video_search, k3_store_writes, x1_scan, k8_deletion_tokens, k17_fitting_previews)}

_USABLE = "len(data_float32) = 64 and len(list_filter(data_float32, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(data_float32, lambda x: x <> 0)) > 0"
_OWN = f"""own as (select record_no, batch_no, vec_key, data_float32::double[] as v, metadata.record_type as record_type, metadata.file_kind as file_kind, metadata.asset_path as asset_path,
  metadata.video_id as video_id, coalesce(metadata.title, '') as title from vector_records where metadata.embedding_space = '{SPACE}' and {_USABLE})"""
_BLANK = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\x{0B}]"

ORACLES = {
    "q3_vector_search": f"""with {_OWN}, q as (select v as wanted from own where file_kind = 'image' order by record_no limit 1
), scored as (select own.*, round(list_cosine_similarity(v, wanted), 9) as score from own, q
), lanes as (select * from scored qualify row_number() over (partition by coalesce(record_type, '') order by score desc, record_no) <= {RECALL}
), best as (select *, coalesce(nullif(asset_path, ''), 'key:' || vec_key) as file from lanes qualify row_number() over (partition by file order by score desc, record_no) = 1
), there as (select *, title as asset_name from best where file not in (select asset_path from asset_hits where file_kind = 'document' and asset_path is not null) or file is null
), """ + BOOSTED.replace("{rows}", "there") + f"""
select record_no, record_type, round(greatest(score, least(1.0, score + boost)), 6) as score from lifted order by 3 desc, 1 limit {ANSWER}""",
    "k3_store_writes": f"""with {_OWN}, newest as (select * from own where vec_key <> '' qualify row_number() over (partition by vec_key order by batch_no > 10 desc, batch_no desc, record_no desc) = 1)
select vec_key, record_no from newest where coalesce(file_kind, '') <> 'image'""",
    "q4_video_search": f"""with {_OWN}, r as (select * from own where video_id <> ''
), e as (select video_id, record_no, unnest(range(1, 65)) as k, unnest(v) as x from r
), m as (select video_id, k, avg(x) as x from e group by 1, 2
), q as (select m.video_id, list(x order by k) as v, any_value(f.query_no) as query_no from m join (select video_id, min(record_no) as query_no from r group by 1 having bool_or(record_no % 50 = 0)) f using (video_id) group by 1
), s as (select q.video_id, q.query_no, r.record_no, r.video_id as found_video, list_cosine_similarity(q.v, r.v) as score from q, r where r.record_no <> q.query_no
), t as (select * from s qualify row_number() over (partition by query_no order by round(score, 9) desc, record_no) <= 60
), b as (select video_id, found_video, round(max(round(score, 5)), 5) as score from t where found_video <> video_id group by 1, 2)
select video_id, cast(row_number() over (partition by video_id order by score desc, found_video) as integer) as rank, found_video, score from b qualify rank <= 5""",
    "k8_deletion_tokens": """with k as (select distinct metadata.video_id as video, vec_key from vector_records where metadata.video_id <> '' and vec_key is not null)
select video, count(*) as keys, cast(sum(cast('0x' || substr(md5(vec_key), 1, 15) as hugeint)) as varchar) as token from k group by 1""",
    "k17_fitting_previews": f"""with t as (select chunk_no, strlen(asset_path) + strlen(library_root) as used, substr(trim(regexp_replace(text, '{_BLANK}+', ' ', 'g')), 1, 100) as p from document_chunks
  where text is not null and asset_path is not null and library_root is not null)
select chunk_no, case when used + strlen(p) <= {METADATA_BYTES} then p end as preview from t""",
}
