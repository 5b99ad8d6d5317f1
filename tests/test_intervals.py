import random

from hypothesis import given, settings
from hypothesis import strategies as st

from shelfspark.operators.intervals import IntervalMap, intervals_of, periods_and_gaps


def brute(rows):
    """Periods and gaps of (entity, start, end) by sorting each entity whole."""
    out = set()
    for entity in {r[0] for r in rows}:
        periods = []
        for _, s, e in sorted(r for r in rows if r[0] == entity):
            if periods and s <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], e)
            else:
                periods.append([s, e])
        out |= {(entity, "period", s, e) for s, e in periods}
        out |= {(entity, "gap", a[1], b[0]) for a, b in zip(periods, periods[1:], strict=False)}
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 15)), max_size=40))
def test_map_is_the_union_of_what_was_added(pairs):
    held = IntervalMap()
    for start, length in pairs:
        held.add(start, start + length)
    assert {("x", "period", s, e) for s, e in zip(held.starts, held.ends, strict=True)} | {("x", "gap", s, e) for s, e in held.gaps()} == brute([("x", s, s + n) for s, n in pairs])


def run(spark, rows, block_ms=1000):
    df = spark.createDataFrame(rows, "entity string, start_ms long, end_ms long").selectExpr("'t' as record_table", "*", "'x' as block", "1 as carry")
    return {tuple(r)[1:] for r in periods_and_gaps(df, block_ms).collect()}


def test_blocks_are_joined_up(spark):
    rng = random.Random(5)
    rows = [("hot", s := rng.randrange(200_000), s + rng.choice([1, 5, 300, 900, 2500, 9000])) for _ in range(1500)]
    rows += [(f"e{i % 40}", s := rng.randrange(8000), s + rng.randrange(1, 1500)) for i in range(600)]
    rows += [("nested", 0, 50_000), ("nested", 10, 20), ("nested", 999, 1001), ("nested", 50_000, 50_001), ("nested", 60_000, 60_001)]
    rows += rows[:200]
    assert run(spark, rows) == brute(rows)


def test_long_intervals_cover_later_blocks(spark):
    rows = [("a", 0, 10_500), ("a", 4_000, 4_100), ("a", 10_400, 10_900), ("a", 12_000, 12_100), ("a", 12_050, 10**13)]
    assert run(spark, rows) == brute(rows)


def test_rows_without_interval(spark):
    nan = float("nan")
    rows = [("a", 1.0, 2.0), ("a", None, 2.0), ("a", 5.0, nan), ("a", 9.0, 8.0), ("a", 3.0, 3.0), (None, 1.0, 2.0), ("a", 3.0, float("inf")), ("b", 1.00049, 1.0006)]
    df = spark.createDataFrame(rows, "v string, s double, e double")
    found = {tuple(r) for r in periods_and_gaps(intervals_of(df, "t", "v", "s", "e")).collect()}
    assert found == {("t", "a", "period", 1000, 2000), ("t", "b", "period", 1000, 1001)}


def test_empty(spark):
    df = spark.createDataFrame([], "v string, s double, e double")
    assert periods_and_gaps(intervals_of(df, "t", "v", "s", "e")).collect() == []
