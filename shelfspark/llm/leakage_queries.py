"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.leakage import build_index, leaks
from shelfspark.sources.tables import spread, table

#: The index of a data folder, by application; it is built once and serves every test set.
_indexes: dict[tuple[str, str], DataFrame] = {}


def training_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positional index of the training documents."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _indexes:
        _indexes[key] = build_index(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")
    return _indexes[key]


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(training_index(spark, sf_dir), table(spark, sf_dir, "eval_items"), "item_id", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items and the documents that hold them."""
    return _leaks(spark, sf_dir).select("item_id", "doc_id")


def p6_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the shares of terms and words and the longest exact phrase in words."""
    return _leaks(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("term_share", "covered_share")})


def p6_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that leaks, with the items it leaks."""
    return _leaks(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("item_id")), ",").alias("items"), F.max("longest_phrase").alias("longest_phrase"))


QUERIES = {"p6_found": p6_found, "p6_matches": p6_matches, "p6_documents": p6_documents}
_WORDS = r"""regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '&(amp;)?#?[A-Za-z0-9]+;', ' ', 'g'), '<[^<>]*>', ' ', 'g'),
  '[\[(]?\b\d{1,2}(:\d\d){1,2}([.,]\d{1,3})?\b[\])]?', ' ', 'g'), '(?m)^\s*\d+\s*$', ' ', 'g')), '[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]|[a-z0-9\x{DF}-\x{24F}]+')"""
_TERMS = r"""list_filter(list_transform(range(1, len(w) + 1), lambda i: case when regexp_matches(w[i], '[\x{3040}-\x{9FFF}]')
  then case when i + 4 <= len(w) then array_to_string(w[i:i + 4], ' ') end else case when i + 2 <= len(w) then array_to_string(w[i:i + 2], ' ') end end), lambda g: g is not null)"""

#: Share of an item's own terms that stand anywhere in the document: the positions only tell near misses further apart.
ORACLES = {
    "p6_found": f"""with worded as (select item_id, {_WORDS.replace("{t}", "text")} as w from eval_items
), begins as (select array_to_string(w[1:k], ' ') as b, count(*) as n from worded, range(1, 61) r(k) where k <= len(w) group by 1 having count(*) >= 5
), leads as (select item_id, max(k) as k from worded, range(1, 61) r(k) where k <= len(w) and array_to_string(w[1:k], ' ') in (select b from begins) group by 1
), own as (select item_id, w[coalesce(k, 0) + 1:] as w from worded left join leads using (item_id)
), items as (select item_id, list_distinct({_TERMS}) as terms from own
), wanted as (select item_id, unnest(terms) as term, len(terms) as n from items
), docs as (select doc_id, {_WORDS.replace("{t}", "text")} as w from documents where text is not null
), held as (select doc_id, unnest(list_distinct({_TERMS})) as term from docs)
select item_id, doc_id from wanted join held using (term) group by item_id, doc_id having count(*) >= 0.4 * any_value(n)""",
}
