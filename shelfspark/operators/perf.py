"""Ingest performance: rates, estimates, comparisons, windows of the newest samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = ("video", "image", "document")


def newest(rows: DataFrame, key: list[str], most: int, *order: Column) -> DataFrame:
    """The newest rows of each key with their ``age``, 1 for the newest; a rank limit is pushed before the shuffle."""
    return rows.withColumn("age", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("age") <= most)


def evicted(rows: DataFrame, key: list[str], per_key: int, overall: int, *order: Column) -> DataFrame:
    """What a bounded history keeps: the newest of each key, and of those the newest overall."""
    kept = newest(rows, key, per_key, *order).drop("age")
    return kept.orderBy(*order).limit(overall)


def kind_rates(samples: DataFrame, key: list[str]) -> DataFrame:
    """Median milliseconds per asset and kind; samples without work or without assets of a kind do not count for it."""
    rate = lambda kind: F.when((F.col(f"work_ms_{kind}") > 0) & (F.col(f"done_{kind}") > 0), F.col(f"work_ms_{kind}") / F.col(f"done_{kind}"))
    return samples.groupBy(*key).agg(*[F.median(rate(k)).alias(f"rate_{k}") for k in KINDS], F.median("concurrency").alias("concurrency"), F.count("*").alias("samples"))


def fallback_rates(samples: DataFrame, exact: list[str], wider: list[str], most_exact: int, most_wider: int, *order: Column) -> DataFrame:
    """Rates per exact key from its newest samples, each kind filled from the wider key where the exact one has none."""
    own = kind_rates(newest(samples, exact, most_exact, *order), exact)
    wide = kind_rates(newest(samples, wider, most_wider, *order), wider).select(*wider, *[F.col(f"rate_{k}").alias(f"wide_{k}") for k in KINDS])
    filled = {f"rate_{k}": F.coalesce(f"rate_{k}", f"wide_{k}") for k in KINDS}
    source = F.when(F.coalesce(*[F.col(f"rate_{k}") for k in KINDS]).isNotNull(), "exact").when(F.coalesce(*[F.col(f"wide_{k}") for k in KINDS]).isNotNull(), "wider").otherwise("none")
    return own.join(wide, wider).withColumn("rate_source", source).withColumns(filled).drop(*[f"wide_{k}" for k in KINDS])


def estimated(rates: DataFrame, pending: dict[str, Column]) -> DataFrame:
    """Milliseconds until the pending assets are done, with a band by the number of samples; null where a rate lacks."""
    need = [F.when(pending[k] > 0, pending[k] * F.col(f"rate_{k}")).otherwise(0.0) for k in KINDS]
    single = [F.when(pending[k] > 0, F.col(f"rate_{k}")).otherwise(0.0) for k in KINDS]
    lanes = F.greatest(F.lit(1), F.floor(F.col("concurrency") + 0.5))
    lacks = reduce(lambda a, b: a | b, [(pending[k] > 0) & F.col(f"rate_{k}").isNull() for k in KINDS])
    total = F.ceil(F.greatest(*single, (need[0] + need[1] + need[2]) / lanes))
    low, high = F.when(F.col("samples") >= 5, 0.8).when(F.col("samples") >= 2, 0.7).otherwise(0.6), F.when(F.col("samples") >= 5, 1.25).when(F.col("samples") >= 2, 1.4).otherwise(1.7)
    known = rates.withColumn("estimate_ms", F.when(~lacks, total))
    return known.withColumns({"least_ms": F.floor(F.col("estimate_ms") * low), "most_ms": F.ceil(F.col("estimate_ms") * high)})


def mode_speedups(samples: DataFrame, key: list[str], mode: str, value: str, base: str, last: int, *order: Column) -> DataFrame:
    """Median of the last runs per key and mode, and how much faster each mode is than the base mode of its key."""
    medians = newest(samples, [*key, mode], last, *order).groupBy(*key, mode).agg(F.median(value).alias("median_ms"), F.count("*").alias("runs"))
    of_base = F.max(F.when(F.col(mode) == base, F.col("median_ms"))).over(W.partitionBy(*key))
    return medians.withColumn("speedup", of_base / F.col("median_ms"))


def best_modes(medians: DataFrame, key: list[str], value: str, tolerance: float = 1e-5) -> DataFrame:
    """Rows within a relative tolerance of the least value of their key, for keys with at least two positive values."""
    by = W.partitionBy(*key)
    positive = medians.where(F.col(value) > 0)
    return positive.withColumns({"least": F.min(value).over(by), "of": F.count("*").over(by)}).where((F.col("of") >= 2) & (F.col(value) <= F.col("least") * (1 + tolerance))).drop("least", "of")


def exact_medians(rows: DataFrame, keys: list[str], value: Column, name: str, around: float = 0.001) -> DataFrame:
    """The keys, count and exact median per group, also of groups with any number of different values.

    Two percentiles of bounded error enclose the middle. Rows outside are only counted; the few values between are counted
    one by one and ranked. So no group is gathered or sorted in one task. Null and NaN values are left out, groups of
    nothing else with them; a null key is a group of its own.
    """
    known = rows.select(*keys, value.cast("double").alias("_value")).where("_value is not null and not isnan(_value)")
    # off by a ten-thousandth of the ranks at most, a tenth of what is left on either side
    bounds = known.groupBy(*keys).agg(F.percentile_approx("_value", [0.5 - around, 0.5 + around], 10_000).alias("_ends"), F.count("*").alias("_rows"))
    same = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    placed = known.alias("r").join(bounds.alias("b"), same).select(*[F.col(f"r.{k}").alias(k) for k in keys], "_value", "_rows", F.col("_ends")[0].alias("_low"), F.col("_ends")[1].alias("_high"))
    # all rows below the bounds are one line, with the least value
    counts = placed.where("_value <= _high").groupBy(*keys, "_rows", F.when(F.col("_value") >= F.col("_low"), F.col("_value")).alias("_at")).agg(F.count("*").alias("_count"))
    upto = F.sum("_count").over(W.partitionBy(*keys).orderBy(F.asc_nulls_first("_at")).rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = counts.withColumn("_upto", upto)
    low, high = F.floor((F.col("_rows") + 1) / 2), F.floor(F.col("_rows") / 2) + 1
    reached = ranked.withColumns({"_first": F.when(F.col("_upto") >= low, F.col("_at")), "_second": F.when(F.col("_upto") >= high, F.col("_at"))})
    return reached.groupBy(*keys, F.col("_rows").alias("count")).agg(((F.min("_first") + F.min("_second")) / 2).alias(name))
