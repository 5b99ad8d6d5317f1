import math
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shelfspark.llm import percentiles as percentiles_module
from shelfspark.llm.percentiles import Compactors, _build, _combinations, _seed, merged, percentiles, sketches


def off(values, answer, share):
    """Rank error of an answer as a share of the count."""
    values = np.sort(values)
    lo, hi, want = np.searchsorted(values, answer, "left") + 1, np.searchsorted(values, answer, "right"), max(1, math.ceil(share * len(values)))
    return max(0, lo - want, want - hi) / len(values)


def test_small_groups_are_exact():
    sketch = Compactors(200)
    sketch.add(np.arange(100.0))
    assert sketch.quantiles([0.5, 0.99, 0.0, 1.0]) == [49.0, 98.0, 0.0, 99.0] and sketch.rank_error() == 0
    assert Compactors().quantiles([0.5]) == [None]


def test_errors_stay_within_the_bound_however_parts_are_merged():
    rng = np.random.default_rng(7)
    values = np.concatenate((rng.lognormal(9, 2, 200_000), np.full(50_000, 4000.0)))
    rng.shuffle(values)
    parts = []
    for k, part in enumerate(np.array_split(values, 37)):
        sketch = Compactors(200, seed=k)
        for batch in np.array_split(part, 9):
            sketch.add(batch)
        parts.append(sketch)
    while len(parts) > 1:
        parts[0].merge(parts.pop())
    sketch = parts[0]
    assert sketch.count == len(values) and sketch.held() < 3000 and 0 < sketch.rank_error() < 0.05
    assert all(off(values, a, s) <= sketch.rank_error() for s, a in zip((0.01, 0.5, 0.9, 0.95, 0.99), sketch.quantiles([0.01, 0.5, 0.9, 0.95, 0.99]), strict=True))


def test_tables_and_days(spark):
    rows = spark.range(60_000).selectExpr("case when id % 3 = 0 then 'hot' else concat('k', id % 50) end as key", "case when id % 7 = 0 then null when id % 7 = 1 then 'A' else '' end as mode", "id % 5 as day", "cast(pow(id % 997, 2) as long) as ms", "'x' as value", "1 as count")
    rows = rows.unionByName(rows.limit(1).withColumn("ms", F.lit(None).cast("long")))
    keys = {"key": F.col("key"), "mode": F.lower("mode")}
    one = percentiles(sketches(rows, keys, F.col("ms"), 100), list(keys), {"p50": 0.5, "p99": 0.99}, 100).collect()
    days = sketches(rows, {"day": F.col("day")} | keys, F.col("ms"), 100)
    two = percentiles(merged(days, list(keys), 100), list(keys), {"p50": 0.5, "p99": 0.99}, 100).collect()
    exact = {(r.key, r.mode): np.array(r.v, float) for r in rows.where("ms is not null").groupBy("key", F.lower("mode").alias("mode")).agg(F.collect_list("ms").alias("v")).collect()}
    for got in (one, two):
        assert {(r.key, r.mode): r["count"] for r in got} == {k: len(v) for k, v in exact.items()}
        assert all(off(exact[r.key, r.mode], r.p50, 0.5) <= r.rank_error and off(exact[r.key, r.mode], r.p99, 0.99) <= r.rank_error for r in got)
    assert any(r.key == "hot" and r.mode is None for r in one)
    assert sketches(rows.limit(0), keys, F.col("ms")).collect() == []


def test_a_task_that_runs_again_gives_the_same_sketch(spark):
    rows = spark.range(0, 50_000, 1, 3).selectExpr("'k' as key", "hash(id) as ms")
    runs = [sketches(rows, {"key": F.col("key")}, F.col("ms"), 50, label) for label in ("a", "a", "b")]
    assert runs[0].first() == runs[1].first() != runs[2].first()
    assert runs[0].first() == runs[0].first()


def test_keys_with_many_values():
    """Only combinations that occur make sketches, and they are passed on when there are many."""
    n = 10_000
    batch = pa.RecordBatch.from_arrays([pa.array([f"a{k}" for k in range(n)]), pa.array([f"b{k * 7 % n}" for k in range(n)]), pa.array(np.arange(n, dtype=float))], names=["a", "b", "value"])
    began = time.perf_counter()
    out = list(_build(["a", "b"], 50, "x")(iter([batch, batch])))
    assert time.perf_counter() - began < 10
    assert sum(b.num_rows for b in out) == n and out[0].column(2).to_pylist() == [2] * n
    codes, keys = _combinations([pa.array([None, "x", None, "y"]), pa.array(["p", None, "p", "p"])], 4)
    assert [keys[c] for c in codes] == [(None, "p"), ("x", None), (None, "p"), ("y", "p")]


def test_many_sketches_are_passed_on(monkeypatch):
    monkeypatch.setattr(percentiles_module, "FLUSH_SKETCHES", 100)
    batch = pa.RecordBatch.from_arrays([pa.array([f"a{k}" for k in range(1000)]), pa.array(np.arange(1000.0))], names=["a", "value"])
    out = list(_build(["a"], 50, "x")(iter([batch])))
    assert len(out) == 10 and sum(b.num_rows for b in out) == 1000


def test_days_that_are_merged_again_and_again():
    """The bound holds for the same values sketched day after day: coins of the days do not add up in one direction."""
    values = np.random.default_rng(3).permutation(20_000).astype(float)
    total = None
    for day in range(60):
        sketch = Compactors(60, seed=_seed(f"day {day}", ("k",), 0))
        for part in np.array_split(values, 20):
            sketch.add(part)
        if total is None:
            total = sketch
        else:
            total = Compactors.restore(total.count, total.variance, total.low, total.high, total.levels, 60, _seed(f"merge {day}", ("k",)))
            total.merge(sketch)
        assert all(off(np.tile(values, day + 1), a, s) <= total.rank_error() for s, a in zip((0.1, 0.5, 0.9), total.quantiles([0.1, 0.5, 0.9]), strict=True)) or day % 20
    assert total.count == 60 * 20_000 and total.held() < 1500 and total.rank_error() < 0.1
