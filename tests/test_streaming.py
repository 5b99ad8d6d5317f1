import json
import random

from pyspark.sql import functions as F

from shelfspark.sources.streams import payload_stream
from shelfspark.streaming import keyed
from tests.test_intervals import brute


def stream_of(spark, path, rows, schema, parts=2):
    """A stream over files, one micro-batch each, in order."""
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


SPANS = "entity string, start_ms long, end_ms long"


def test_interval_maps_over_many_micro_batches(spark):
    """State is read, changed and written again by each of nine micro-batches; periods and gaps come out of it."""
    rng = random.Random(5)
    rows = [("hot", s := rng.randrange(200_000), s + rng.choice([1, 5, 300, 900, 2500, 9000])) for _ in range(1500)]
    rows += [(f"e{i % 40}", s := rng.randrange(8000), s + rng.randrange(1, 1500)) for i in range(600)]
    rows += [("a", 0, 10), ("a", 20, 30), ("a", 10, 20), ("a", 5_000_000, 5_000_001), ("b", 3, 4), ("b", None, 4), (None, 1, 2), ("b", 4, 4), ("a", 0, 10)] + rows[:200]
    df = spark.createDataFrame(rows, SPANS).selectExpr("'t' as record_table", "*", "'x' as block", "1 as change")
    for block_ms in (1000, 10**9):
        got = {tuple(r)[1:] for r in keyed.streamed_periods_and_gaps(df, 9, block_ms).collect()}
        assert got == brute([r for r in rows if None not in r and r[2] > r[1]])
    assert keyed.streamed_periods_and_gaps(df.limit(0)).collect() == []


def test_only_changes_leave_the_stream(spark, tmp_path):
    schema = "record_table string, entity string, block long, starts array<long>, ends array<long>, gap_ends array<long>"
    maps = [("t", "a", 0, [0, 20], [10, 30], [20]), ("t", "a", 0, [5], [8], []), ("t", "a", 0, [10, 40], [20, 50], [40])]
    for row in maps:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    keyed.run_to_table(keyed.interval_changes(stream, 1), str(tmp_path / "out"), str(tmp_path / "progress"), "update")
    changes = spark.read.parquet(str(tmp_path / "out"))
    by_batch = {k: {(r.span_kind, r.start_ms, r.end_ms, r.change) for r in changes.where(f"micro_batch = {k}").collect()} for k in range(3)}
    assert by_batch[0] == {("period", 0, 10, 1), ("period", 20, 30, 1), ("gap", 10, 20, 1)} and by_batch[1] == set()
    assert by_batch[2] == {("period", 0, 10, -1), ("period", 20, 30, -1), ("gap", 10, 20, -1), ("period", 0, 30, 1), ("period", 40, 50, 1), ("gap", 30, 40, 1)}


def test_frames_that_look_alike(spark, tmp_path):
    zero, near, far = "0" * 16, "0" * 15 + "7", "f" * 16
    rows = [("v", 0.0, zero), ("v", 1.0, near), ("v", 2.0, far), ("v", 3.0, far), ("v", 25.0, far), ("w", 0.0, far), (None, 0.0, far)]
    spark.createDataFrame(rows, "video string, at double, hash string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("video string, at double, hash string").parquet(str(tmp_path / "in"))
    keyed.run_to_table(keyed.distinct_frames(stream), str(tmp_path / "out"), str(tmp_path / "progress"))
    assert {(r.video, r.at) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("v", 0.0), ("v", 2.0), ("v", 25.0), ("w", 0.0)}


def test_payloads_and_first_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"kind": "video", "video": v, "captured_at": f"2026-01-01T00:00:0{i}"}) for i, v in enumerate("aba")] + ["no json"]
    (tmp_path / "in" / "x.json").write_text("\n".join(lines))
    stream = payload_stream(spark, str(tmp_path / "in")).where("video is not null").select("video", F.col("captured_at").alias("at"))
    keyed.run_to_table(keyed.first_arrivals(stream, ["video"]), str(tmp_path / "out"), str(tmp_path / "progress"))
    assert sorted(r.video for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_sessions(spark, tmp_path):
    rows = [("k", f"2026-01-01 00:00:{s:02}") for s in (0, 5, 10, 40)] + [("k", "2026-01-01 01:00:00")]
    spark.createDataFrame(rows, "key string, at string").selectExpr("key", "cast(at as timestamp) as at").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, at timestamp").parquet(str(tmp_path / "in"))
    keyed.run_to_table(keyed.sessions(stream), str(tmp_path / "out"), str(tmp_path / "progress"))
    assert sorted(r.events for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3]
