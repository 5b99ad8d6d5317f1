"""Mixing sources to target weights (problem 7): hash-threshold histograms.

Every document has a hash of its number. A source's documents below a threshold of that hash are a selection that needs
no sorting, and a lower threshold selects a part of what a higher one does, so the selections of several mixes nest.

1. One pass sums tokens by source and hash bucket (the top ``BUCKET_BITS`` bits). That histogram is small however many
   documents there are, and a hot source is summed in the map tasks before anything moves. The size of a source and of
   all documents, and so what a source can reach, are sums over its buckets.
2. Per mix and source, whole copies are taken while the budget exceeds the source; the running sum over the buckets
   finds the bucket in which the rest of the budget ends.
3. Only the documents of such boundary buckets are summed again, by the next bits, and so on for ``LEVELS`` levels; the
   threshold ends before the finest bucket that would exceed the budget.
4. A filter on the hash gives the selection; each document comes with how often it is taken.

A source that cannot reach its share with ``max_repeats`` copies gives all of them and is reported as short. Spellings of
a source count together. A source that is null in the documents is no target, but its tokens count in the total. A
target whose source, share, ratio or number of repeats is null is taken as 0. Empty tables give empty results; targets
without documents are short. Documents that come twice are two documents of one hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.llm.tokens import VOCABULARY, counter, ship
from shelfspark.session import as_table

BUCKET_BITS = 10
LEVELS = 3
HASH_BITS = 62


def plain_source(source: Column) -> Column:
    """One spelling per source: lower case, words joined by underscores; null if blank."""
    text = F.regexp_replace(F.regexp_replace(F.lower(source), r"[\s\p{Z}_\-./]+", "_"), "^_+|_+$", "")
    return F.when(text != "", text)


def sized(documents: DataFrame, doc_id: str, text: str, source: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens, hash) as a written table, so that texts are counted once."""
    ship(documents.sparkSession, vocabulary)
    spread = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), plain_source(F.col(source)).alias("source"))
    return as_table(
        spread.select(
            "doc_id", "source", counter(vocabulary)("text").alias("tokens"), F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - HASH_BITS).alias("hash")
        ),
        "sized",
    )


def _bucket(level: int) -> Column:
    """Bucket of a level: the top (level + 1) * BUCKET_BITS bits of the hash."""
    return F.shiftright("hash", HASH_BITS - BUCKET_BITS * (level + 1))


def histogram(sizes: DataFrame) -> DataFrame:
    """(source, prefix, bucket, tokens) of the first level as a written table: at most 2 ** ``BUCKET_BITS`` rows per source."""
    first = sizes.groupBy("source", F.lit(0).cast("long").alias("prefix"), _bucket(0).alias("bucket")).agg(F.sum("tokens").alias("tokens"))
    return as_table(first, "histogram")


def budgets(targets: DataFrame, buckets: DataFrame) -> DataFrame:
    """Per mix and source: budget, tokens of the source, whole copies, the rest of the budget, and whether it falls short.

    ``buckets`` comes from :func:`histogram`.
    """
    by_source = buckets.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    total = buckets.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]  # one number
    wanted = targets.select(
        "mix_id",
        F.col("source").alias("source_as_given"),
        plain_source(F.col("source")).alias("source"),
        F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("target_share"),
        F.coalesce(F.col("max_repeats").cast("long"), F.lit(0)).alias("max_repeats"),
        F.coalesce(F.col("budget_ratio").cast("double"), F.lit(0.0)).alias("budget_ratio"),
    )
    reach = F.col("max_repeats") * F.col("source_tokens")
    return (
        wanted.join(by_source, "source", "left")
        .withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
        .withColumn("budget", F.col("target_share") * F.col("budget_ratio") * F.lit(total))
        .withColumn("short", F.col("budget") > reach)
        .withColumn("copies", F.when(F.col("short"), F.col("max_repeats")).when(F.col("source_tokens") == 0, 0).otherwise(F.floor(F.col("budget") / F.col("source_tokens"))))
        .withColumn("rest", F.when(F.col("short"), 0.0).otherwise(F.col("budget") - F.col("copies") * F.col("source_tokens")))
    )


def thresholds(wanted: DataFrame, sizes: DataFrame, buckets: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Adds ``threshold``: documents of the source with a hash below it fill the rest of the budget, but for what one finest bucket holds."""
    # ``prefix`` is the boundary bucket found so far, ``left`` the budget from its first hash on
    open_rows = wanted.where("rest > 0").select("mix_id", "source", F.lit(0).cast("long").alias("prefix"), F.col("rest").alias("left"))
    for level in range(levels):
        if level:
            # only the boundary buckets of the level before are summed again
            within = sizes.where("source is not null").withColumn("prefix", _bucket(level - 1)).join(open_rows.select("source", "prefix").distinct(), ["source", "prefix"], "left_semi")
            finer = within.groupBy("source", "prefix", _bucket(level).alias("bucket")).agg(F.sum("tokens").alias("tokens"))
        else:
            finer = buckets.where("source is not null")
        running = W.partitionBy("mix_id", "source").orderBy("bucket")
        steps = open_rows.join(finer, ["source", "prefix"]).withColumn("sum", F.sum("tokens").over(running.rowsBetween(W.unboundedPreceding, 0)))
        # the first bucket whose running sum exceeds what is left
        open_rows = (
            steps.where("sum > left")
            .groupBy("mix_id", "source")
            .agg(F.min_by(F.struct(F.col("bucket").alias("prefix"), (F.col("left") - F.col("sum") + F.col("tokens")).alias("left")), "bucket").alias("edge"))
            .select("mix_id", "source", "edge.prefix", "edge.left")
        )
        open_rows = as_table(open_rows, f"edges-{level}")  # a few rows per mix; ends the lineage between levels
    shift = HASH_BITS - BUCKET_BITS * levels
    found = open_rows.select("mix_id", "source", F.shiftleft("prefix", shift).alias("threshold"))
    return wanted.join(found, ["mix_id", "source"], "left").withColumn("threshold", F.coalesce("threshold", F.lit(0)))


def selection(planned: DataFrame, sizes: DataFrame) -> DataFrame:
    """(mix_id, doc_id, source, tokens, times): the documents of each mix and how often each is taken."""
    times = F.col("copies") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    return (
        sizes.where("source is not null")
        .join(planned.select("mix_id", "source", "copies", "threshold"), "source")
        .select("mix_id", "doc_id", "source", "tokens", times.cast("int").alias("times"))
        .where("times > 0")
    )


def shares(planned: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per row of the targets: tokens taken, share of the mix reached, whether the source fell short."""
    taken = selection(planned, sizes).groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("times")).alias("tokens_taken"), F.sum("times").alias("documents_taken"))
    joined = planned.join(taken, ["mix_id", "source"], "left").withColumn("tokens_taken", F.coalesce("tokens_taken", F.lit(0)))
    mix = F.sum("tokens_taken").over(W.partitionBy("mix_id"))
    return joined.select(
        "mix_id",
        F.col("source_as_given").alias("source"),
        "target_share",
        F.when(mix > 0, F.col("tokens_taken") / mix).otherwise(0.0).alias("reached_share"),
        "budget",
        "tokens_taken",
        F.coalesce("documents_taken", F.lit(0)).alias("documents_taken"),
        "copies",
        "short",
    )
