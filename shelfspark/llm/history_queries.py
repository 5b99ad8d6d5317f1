"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.history import entries_of, epoch_us, plain_paths, plain_uuid, repeats
from shelfspark.session import as_table
from shelfspark.sources.tables import table


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "asset_hits").select("hit_no", "batch_no", "asset_path", "segment_index", "modified_at")
    files = entries_of(
        hits,
        "asset_hits",
        "batch_no",
        "hit_no",
        F.concat(F.col("segment_index").cast("string"), F.lit("\n"), plain_paths("asset_path")),
        epoch_us(F.col("modified_at")),
    )
    records = table(spark, sf_dir, "vector_records").select("record_no", "batch_no", "vec_key")
    keys = entries_of(records, "vector_records", "batch_no", "record_no", plain_uuid(F.col("vec_key")), None)
    entries = as_table(files.unionByName(keys), "entries", partition_by=["batch_no"])
    batches = [r[0] for r in entries.select("batch_no").distinct().orderBy("batch_no").collect()]  # batches are few: they are the loads so far
    return repeats(spark, entries, batches)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that repeat an accepted row, with that row."""
    return _judged(spark, sf_dir).where("first_no is not null").select("record_table", "first_no", F.col("row_no").alias("dup_no"))


def p1_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table and batch: rows accepted and repeated."""
    return (
        _judged(spark, sf_dir)
        .groupBy("record_table", "batch_no")
        .agg(F.count_if(F.col("first_no").isNull()).alias("accepted"), F.count("first_no").alias("repeated"))
    )


QUERIES = {"p1_found": p1_found, "p1_batches": p1_batches}
#: The first row in order within the tolerance. That is the accepted row unless repeats form chains of several steps,
#: which these tables do not hold; the tests hold the operator against going through all rows in order.
ORACLES = {
    "p1_found": r"""with decoded as (
  select hit_no, batch_no, segment_index, modified_at, replace(url_decode(replace(asset_path, '+', '%2B')), '\', '/') as d from asset_hits
), trimmed as (select * exclude (d), regexp_replace(regexp_replace(d, '[\s\x{A0}]+$', ''), '^[\s\x{A0}]*((?i)file:(//(localhost)?)?)?[\s\x{A0}]*', '') as e from decoded
), spelled as (
  select hit_no, batch_no, segment_index, modified_at, lower(nfc_normalize(replace(e, chr(160), ' '))) as p from trimmed
), steps as (select *, regexp_replace(regexp_replace(p, '/+', '/', 'g'), '(/\.)+/', '/', 'g') as a from spelled
), up as (select *, regexp_replace(regexp_replace(regexp_replace(a, '/[^/]+/\.\./', '/'), '/[^/]+/\.\./', '/'), '/[^/]+/\.\./', '/') as path from steps
), hits as (
  select hit_no, batch_no, path, segment_index, case when modified_at < 1e11 then modified_at * 1e6 when modified_at < 1e14 then modified_at * 1e3 else modified_at end as t
  from up where modified_at > 0 and not isnan(modified_at) and segment_index is not null and path is not null
), keys as (
  select record_no, batch_no, regexp_replace(regexp_replace(lower(vec_key), '^\s*urn:uuid:', ''), '[\s{}-]', '', 'g') as k from vector_records
), rows as (
  select 'asset_hits' as record_table, path || ':' || segment_index as name, batch_no, hit_no as no, round(t) as t from hits
  union all
  select 'vector_records', k, batch_no, record_no, 0 from keys where regexp_full_match(k, '[0-9a-f]{32}')
), pairs as (
  select b.record_table, b.no as dup_no, arg_min(a.no, (a.batch_no, a.no)) as first_no
  from rows a join rows b on a.record_table = b.record_table and a.name = b.name and (a.batch_no, a.no) < (b.batch_no, b.no) and abs(a.t - b.t) < 3000000
  group by 1, 2)
select record_table, first_no, dup_no from pairs""",
}
