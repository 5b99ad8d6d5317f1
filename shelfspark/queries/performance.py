"""Queries over ingest samples, and over lineitem as a larger table of the same shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators import perf
from shelfspark.sources.tables import table


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ingest_samples")


def _order() -> list:
    return [F.desc("sampled_at_ms"), F.desc("sample_no")]


def a9_kind_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median milliseconds per asset and kind over the last 20 samples of each workload."""
    rates = perf.kind_rates(perf.newest(_samples(spark, sf_dir), ["workload_key"], 20, *_order()), ["workload_key"])
    return rates.select("workload_key", *[F.round(f"rate_{k}", 4).alias(f"rate_{k}") for k in perf.KINDS], "concurrency", "samples")


def a9_fallback_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, a kind without a rate filled from the last 40 samples of the provider."""
    samples = _samples(spark, sf_dir).withColumn("work_ms_image", F.when(F.col("done_image") > 4, F.col("work_ms_image")))
    rates = perf.fallback_rates(samples, ["provider_key", "workload_key"], ["provider_key"], 20, 40, *_order())
    return rates.select("provider_key", "workload_key", F.round("rate_image", 4).alias("rate_image"), "rate_source")


def a10_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time until 4 videos, 2 images and 10 documents are done, per workload."""
    rates = perf.kind_rates(perf.newest(_samples(spark, sf_dir), ["workload_key"], 20, *_order()), ["workload_key"])
    found = perf.estimated(rates, {"video": F.lit(4), "image": F.lit(2), "document": F.lit(10)})
    return found.select("workload_key", "samples", "estimate_ms", "least_ms", "most_ms")


def a12_mode_speedups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of the last three runs per workload and mode, and the speedup over mode a."""
    runs = _samples(spark, sf_dir).where("failed = 0 and elapsed_ms > 0 and execution_mode <> ''").withColumn("mode", F.lower("execution_mode"))
    found = perf.mode_speedups(runs, ["workload_key"], "mode", "elapsed_ms", "a", 3, *_order())
    return found.select("workload_key", "mode", "median_ms", "runs", F.round("speedup", 6).alias("speedup"))


def a14_best_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fastest mode of every workload that ran in at least two."""
    runs = _samples(spark, sf_dir).where("failed = 0 and elapsed_ms > 0 and execution_mode <> ''").withColumn("mode", F.lower("execution_mode"))
    medians = perf.mode_speedups(runs, ["workload_key"], "mode", "elapsed_ms", "a", 3, *_order())
    return perf.best_modes(medians, ["workload_key"], "median_ms").select("workload_key", "mode", "median_ms")


def a13_admitted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete runs, one per workload and start, the last 80 of each workload."""
    runs = _samples(spark, sf_dir).where("failed = 0 and elapsed_ms > 0 and vectors > 0").dropDuplicates(["workload_key", "sampled_at_ms"])
    return perf.newest(runs, ["workload_key"], 80, F.desc("sampled_at_ms")).groupBy("workload_key").agg(F.count("*").alias("runs"), F.min("sampled_at_ms").alias("oldest"), F.max("sampled_at_ms").alias("newest"))


def a11_provider_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact median time and files per second of each provider."""
    files = F.col("done_video") + F.col("done_image") + F.col("done_document")
    rows = _samples(spark, sf_dir).where("elapsed_ms > 0")
    times = perf.exact_medians(rows, ["provider_key"], F.col("elapsed_ms"), "median_ms").drop("count")
    rates = perf.exact_medians(rows, ["provider_key"], files / (F.col("elapsed_ms") / 1000), "files_per_second").select(F.col("provider_key").alias("key"), F.round("files_per_second", 6).alias("files_per_second"))
    return times.join(rates, times["provider_key"].eqNullSafe(rates["key"]), "left").drop("key")


def a15_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, hours and files per hour of each day and storage provider."""
    day = F.to_date(F.timestamp_millis("sampled_at_ms")).cast("string")
    files = F.col("done_video") + F.col("done_image") + F.col("done_document")
    rows = _samples(spark, sf_dir).where("elapsed_ms > 0")
    return rows.groupBy(day.alias("day"), "storage_provider").agg(F.sum(files).alias("files"), F.sum("elapsed_ms").alias("elapsed_ms")).withColumn("files_per_hour", F.round(F.col("files") / (F.col("elapsed_ms") / 3_600_000), 6))


def a16_timing_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work per kind and mode, of the values that are not negative."""
    kept = lambda c: F.sum(F.when(F.col(c) >= 0, F.col(c)).otherwise(0)).alias(c)
    mode = F.coalesce(F.lower("execution_mode"), F.lit("none"))
    return _samples(spark, sf_dir).groupBy(mode.alias("mode")).agg(*[kept(f"work_ms_{k}") for k in perf.KINDS], F.count("*").alias("samples"))


def a17_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files taken in, failed and stored per workload."""
    rows = _samples(spark, sf_dir)
    return rows.groupBy("workload_key").agg(*[F.sum(f"done_{k}").alias(f"done_{k}") for k in perf.KINDS], F.sum("failed").alias("failed"), F.sum("vectors").alias("vectors"))


def k6_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a history of 40 samples per workload and 240 in all keeps."""
    return perf.evicted(_samples(spark, sf_dir), ["workload_key"], 40, 240, *_order()).select("sample_no", "workload_key", "sampled_at_ms")


def t11_last_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 20 samples of each provider."""
    return perf.newest(_samples(spark, sf_dir), ["provider_key"], 20, *_order()).select("sample_no", "provider_key", "age")


def s25_valid_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples per provider that are complete and those that are not."""
    whole = F.col("provider_key").isNotNull() & F.col("workload_key").isNotNull() & (F.col("elapsed_ms") > 0) & (F.col("concurrency") >= 1)
    return _samples(spark, sf_dir).groupBy("provider_key").agg(F.count_if(F.coalesce(whole, F.lit(False))).alias("valid"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("dropped"))


def a9_lineitem_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median price per piece by flag and status: the rate of the samples on a larger table."""
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    medians = perf.exact_medians(rows, ["l_returnflag", "l_linestatus"], F.col("l_extendedprice") / F.col("l_quantity"), "median_price")
    return medians.select("l_returnflag", "l_linestatus", F.round("median_price", 4).alias("median_price"), F.col("count").alias("items"))


QUERIES = {
    f.__name__: f
    for f in (
        a9_kind_rates, a9_fallback_rates, a10_estimates, a12_mode_speedups, a14_best_modes, a13_admitted_runs, a11_provider_medians, a15_throughput,
        a16_timing_sums, a17_counters, k6_history, t11_last_samples, s25_valid_history, a9_lineitem_medians,
    )
}

_LAST = "qualify row_number() over (partition by {k} order by sampled_at_ms desc, sample_no desc) <= {n}"
_RATE = "median(case when work_ms_{k} > 0 and done_{k} > 0 then work_ms_{k} / done_{k} end)"
_RATES = f"""with newest as (select * from ingest_samples {_LAST.format(k="workload_key", n=20)}
), rates as (select workload_key, {_RATE.format(k="video")} as v, {_RATE.format(k="image")} as i, {_RATE.format(k="document")} as d,
  median(concurrency) as concurrency, count(*) as samples from newest group by 1)
"""
_MODES = f"""with runs as (select *, lower(execution_mode) as mode from ingest_samples where failed = 0 and elapsed_ms > 0 and execution_mode <> ''
), newest as (select * from runs {_LAST.format(k="workload_key, mode", n=3)}
), medians as (select workload_key, mode, median(elapsed_ms) as median_ms, count(*) as runs from newest group by 1, 2)
"""
_FILES = "(done_video + done_image + done_document)"

ORACLES = {
    "a9_kind_rates": _RATES + "select workload_key, round(v, 4) as rate_video, round(i, 4) as rate_image, round(d, 4) as rate_document, concurrency, samples from rates",
    "a9_fallback_rates": f"""with samples as (select * replace (case when done_image > 4 then work_ms_image end as work_ms_image) from ingest_samples
), own as (select provider_key, workload_key, {_RATE.format(k="image")} as i, coalesce({_RATE.format(k="video")}, {_RATE.format(k="image")}, {_RATE.format(k="document")}) as any_rate
  from (select * from samples {_LAST.format(k="provider_key, workload_key", n=20)}) group by 1, 2
), wide as (select provider_key, {_RATE.format(k="image")} as i, coalesce({_RATE.format(k="video")}, {_RATE.format(k="image")}, {_RATE.format(k="document")}) as any_rate
  from (select * from samples {_LAST.format(k="provider_key", n=40)}) group by 1)
select o.provider_key, o.workload_key, round(coalesce(o.i, w.i), 4) as rate_image,
  case when o.any_rate is not null then 'exact' when w.any_rate is not null then 'wider' else 'none' end as rate_source from own o join wide w using (provider_key)""",
    "a10_estimates": _RATES + """, done as (select workload_key, samples, case when v is not null and i is not null and d is not null
  then cast(ceil(greatest(v, i, d, (4 * v + 2 * i + 10 * d) / greatest(1, floor(concurrency + 0.5)))) as bigint) end as estimate_ms from rates)
select workload_key, samples, estimate_ms, cast(floor(estimate_ms * (case when samples >= 5 then 0.8::double when samples >= 2 then 0.7::double else 0.6::double end)) as bigint) as least_ms,
  cast(ceil(estimate_ms * (case when samples >= 5 then 1.25::double when samples >= 2 then 1.4::double else 1.7::double end)) as bigint) as most_ms from done""",
    "a12_mode_speedups": _MODES + "select *, round(max(case when mode = 'a' then median_ms end) over (partition by workload_key) / median_ms, 6) as speedup from medians",
    "a14_best_modes": _MODES + """select workload_key, mode, median_ms from medians
qualify count(*) over (partition by workload_key) >= 2 and median_ms <= min(median_ms) over (partition by workload_key) * 1.00001""",
    "a13_admitted_runs": """with runs as (select distinct workload_key, sampled_at_ms from ingest_samples where failed = 0 and elapsed_ms > 0 and vectors > 0
), newest as (select * from runs qualify row_number() over (partition by workload_key order by sampled_at_ms desc) <= 80)
select workload_key, count(*) as runs, min(sampled_at_ms) as oldest, max(sampled_at_ms) as newest from newest group by 1""",
    "a11_provider_medians": f"""select provider_key, median(elapsed_ms) as median_ms, round(median({_FILES} / (elapsed_ms / 1000)), 6) as files_per_second
from ingest_samples where elapsed_ms > 0 group by 1""",
    "a15_throughput": f"""select cast(cast(make_timestamp(sampled_at_ms * 1000) as date) as varchar) as day, storage_provider, cast(sum({_FILES}) as bigint) as files, cast(sum(elapsed_ms) as bigint) as elapsed_ms,
  round(sum({_FILES}) / (sum(elapsed_ms) / 3600000), 6) as files_per_hour from ingest_samples where elapsed_ms > 0 group by 1, 2""",
    "a16_timing_sums": """select coalesce(lower(execution_mode), 'none') as mode, cast(sum(greatest(work_ms_video, 0)) as bigint) as work_ms_video,
  cast(sum(greatest(work_ms_image, 0)) as bigint) as work_ms_image, cast(sum(greatest(work_ms_document, 0)) as bigint) as work_ms_document, count(*) as samples from ingest_samples group by 1""",
    "a17_counters": """select workload_key, cast(sum(done_video) as bigint) as done_video, cast(sum(done_image) as bigint) as done_image, cast(sum(done_document) as bigint) as done_document,
  cast(sum(failed) as bigint) as failed, cast(sum(vectors) as bigint) as vectors from ingest_samples group by 1""",
    "k6_history": f"""select sample_no, workload_key, sampled_at_ms from (select * from ingest_samples {_LAST.format(k="workload_key", n=40)})
order by sampled_at_ms desc, sample_no desc limit 240""",
    "t11_last_samples": """select sample_no, provider_key, cast(row_number() over (partition by provider_key order by sampled_at_ms desc, sample_no desc) as integer) as age from ingest_samples
qualify age <= 20""",
    "s25_valid_history": """select provider_key, count(*) filter (where workload_key is not null and elapsed_ms > 0 and concurrency >= 1 and provider_key is not null) as valid,
  count(*) filter (where not coalesce(workload_key is not null and elapsed_ms > 0 and concurrency >= 1 and provider_key is not null, false)) as dropped from ingest_samples group by 1""",
    "a9_lineitem_medians": """select l_returnflag, l_linestatus, round(median(l_extendedprice / l_quantity), 4) as median_price, count(*) as items
from lineitem where l_quantity > 0 group by 1, 2""",
}
