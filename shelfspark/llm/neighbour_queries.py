"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.neighbours import class_members, classes, most_similar, pairs_within, representative_pairs, usable
from shelfspark.sources.tables import table

ALIKE = 0.95


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable(table(spark, sf_dir, "vector_records"), "record_no", "data_float32", F.col("metadata.embedding_space"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of one embedding space with a cosine similarity of at least 0.95."""
    return pairs_within(_vectors(spark, sf_dir), ALIKE)


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar rows for every row whose number is divisible by 50, against all rows."""
    return most_similar(_vectors(spark, sf_dir), lambda numbers: numbers % 50 == 0).withColumn("similarity", F.round("similarity", 6))


def p5_class_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs between the first rows of classes of exact copies."""
    vectors = _vectors(spark, sf_dir)
    return representative_pairs(vectors, ALIKE, classes(vectors)).select("first_no", "second_no")


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable row with its class of exact copies, for the pairs of p5_class_pairs."""
    return class_members(_vectors(spark, sf_dir))


QUERIES = {"p5_found": p5_found, "p5_neighbours": p5_neighbours, "p5_class_pairs": p5_class_pairs, "p5_classes": p5_classes}
_USABLE = """select record_no, metadata.embedding_space as space, data_float32 as raw, data_float32::double[] as v from vector_records
  where len(data_float32) = 64 and len(list_filter(data_float32, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(data_float32, lambda x: x <> 0)) > 0"""

#: Brute force over all pairs of a space.
ORACLES = {
    "p5_found": f"""with u as ({_USABLE})
select a.record_no as first_no, b.record_no as second_no from u a join u b on a.space = b.space and a.record_no < b.record_no and list_cosine_similarity(a.v, b.v) >= {ALIKE}""",
    "p5_classes": f"""with u as ({_USABLE}), c as (select space, raw, min(record_no) as class_no, count(*) as copies from u group by 1, 2)
select u.record_no, c.class_no, c.copies from u join c on u.space = c.space and u.raw = c.raw""",
    "p5_class_pairs": f"""with u as ({_USABLE}), first as (select space, raw, min(record_no) as record_no, any_value(v) as v from u group by 1, 2)
select a.record_no as first_no, b.record_no as second_no
from first a join first b on a.space = b.space and a.record_no < b.record_no and list_cosine_similarity(a.v, b.v) >= {ALIKE}""",
}
