from pyspark.sql import functions as F

from shelfspark.operators import library, perf, video


def files(spark, rows):
    return spark.createDataFrame(rows, "root string, path string, kind string, fingerprint string")


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "root string, path string, fingerprint string, current boolean, written long")


def test_scan_states(spark):
    disk = files(spark, [("r", "new", "image", "1:1"), ("r", "same", "image", "1:1"), ("r", "changed", "image", "2:1"), ("r", "old-form", "image", "1:1")])
    index = rows_of(spark, [("r", "same", "1:1", True, 1), ("r", "same", "1:1", True, 2), ("r", "changed", "1:1", True, 1), ("r", "gone", "1:1", True, 1), ("r", "old-form", "1:1", False, 1), ("other", "new", "1:1", True, 1)])
    got = {(r.root, r.path): r.state for r in library.scan_states(disk, index).collect()}
    assert got == {("r", "new"): "pending", ("r", "same"): "skipped", ("r", "changed"): "pending", ("r", "old-form"): "pending", ("r", "gone"): "vanished", ("other", "new"): "vanished"}


def test_coverage(spark):
    disk = files(spark, [("r", "a.png", "image", "1:1"), ("r", "b.txt", "document", "1:1"), ("r", "c.txt", "document", "2:2")])
    index = rows_of(spark, [("r", "b.txt", "0:0", True, 1), ("r", "b.txt", "1:1", True, 2), ("r", "c.txt", "1:1", True, 1), ("r", "d.txt", "1:1", True, 1)])
    states = library.coverage(disk, index)
    assert {r.path: r.state for r in states.collect()} == {"a.png": "pending", "b.txt": "cached", "c.txt": "stale", "d.txt": "missing"}
    totals = {(r.root, r.kind): (r.cached, r.pending, r.stale, r.missing) for r in library.coverage_totals(states).collect()}
    assert totals[None, None] == (1, 1, 1, 1) and totals["r", "image"] == (0, 1, 0, 0) and totals["r", "document"] == (1, 0, 1, 0)
    assert {(r.path, r["rows"]) for r in library.missing_by_file(index, disk).collect()} == {("d.txt", 1)}
    assert library.coverage(disk.limit(0), index.limit(0)).collect() == []


def test_sidecars(spark):
    paths = spark.createDataFrame([("/a/clip.mp4",), ("/a/CLIP.srt",), ("/a/b/clip.txt",), ("/z/y/clip.md",), ("/a/b/other.mp4",), ("/q/other.json",), ("/x/lone.mp4",), ("/a/clip.py",)], "path string")
    got = {r.path: (r.partner, r.steps) for r in library.sidecars(paths, paths).collect()}
    assert got["/a/clip.mp4"] == ("/a/CLIP.srt", 0) and got["/a/b/other.mp4"] == ("/q/other.json", 3) and "/x/lone.mp4" not in got
    assert got["/a/CLIP.srt"] == ("/a/b/clip.txt", 1)


def test_roots(spark):
    roots = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",)], "root string")
    paths = spark.createDataFrame([("/a/b/c.mp4",), ("/a/x.mp4",), ("/abc/x.mp4",), ("/ab/x.mp4",)], "path string")
    assert {r.path: r.owner for r in library.owning_root(paths, roots).collect()} == {"/a/b/c.mp4": "/a/b", "/a/x.mp4": "/a", "/abc/x.mp4": None, "/ab/x.mp4": "/ab"}
    assert [tuple(r) for r in library.overlapping_roots(roots).collect()] == [("/a/b", "/a")]


def test_stale_keys(spark):
    old = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "path string, key string")
    fresh = spark.createDataFrame([("a", "1")], "path string, key string")
    assert [tuple(r) for r in library.stale_keys(old, fresh).collect()] == [("a", "2")]


def test_video_list_and_holes(spark):
    rows = [("s", "v", "visual", 1, 0, 10.0, 100, "t"), ("s", "v", "visual", 2, 2, 25.0, 300, "u"), ("s", "v", "transcript", 0, 1, None, 200, "w"), ("s", "", "visual", 3, 0, 1.0, 1, ""), ("s", "v2", "transcript", 9, -1, float("nan"), None, None)]
    df = spark.createDataFrame(rows, "site string, video string, lane string, order_no long, segment_index int, end_seconds double, taken_ms long, title string")
    got = {r.video: r for r in video.video_list(df).collect()}
    assert set(got) == {"v", "v2"}
    v = got["v"]
    assert (v.visual_count, v.transcript_count, v.visual_segments, v.duration, v.taken_ms, v.title) == (2, 1, 2, 25.0, 300, "t")
    assert [tuple(r) for r in video.missing_segments(df.where("lane = 'visual'")).collect()] == [("v", 1)]
    points = {r.video: (r.total_blocks, r.resume_at) for r in video.resume_points(df, F.lit(10.0)).collect()}
    assert points["v"] == (3, -1) and points["v2"] == (0, -1)


def test_media_segments(spark):
    steady = [("a", i, i * 0.5) for i in range(40)]
    jump = [("b", i, i * 0.5) for i in range(10)] + [("b", 10 + i, 50 + i * 0.5) for i in range(20)]
    df = spark.createDataFrame(steady + jump, "video string, arrival long, position double")
    got = {(r.video, r.segment_index): r.frames for r in video.media_segments(df).collect()}
    assert got == {("a", 0): 20, ("a", 1): 20, ("b", 5): 20}


def sample(spark, rows):
    return spark.createDataFrame(rows, "workload_key string, provider_key string, at long, concurrency int, done_video int, work_ms_video long, done_image int, work_ms_image long, done_document int, work_ms_document long")


def test_estimates(spark):
    rows = [("w", "p", 1, 2, 2, 20_000, 3, 3_000, 0, 0), ("new", "p", 2, 2, 0, 0, 0, 0, 0, 0)]
    rates = perf.kind_rates(sample(spark, rows), ["workload_key"])
    need = {"video": F.lit(4), "image": F.lit(2), "document": F.lit(0)}
    got = {r.workload_key: r for r in perf.estimated(rates, need).collect()}
    assert got["w"].estimate_ms == 21_000 and got["w"].least_ms == 12_600 and got["w"].most_ms == 35_700 and got["new"].estimate_ms is None
    filled = perf.fallback_rates(sample(spark, rows), ["provider_key", "workload_key"], ["provider_key"], 20, 40, F.desc("at"))
    assert {r.workload_key: (r.rate_video, r.rate_source) for r in filled.collect()} == {"w": (10_000.0, "exact"), "new": (10_000.0, "wider")}


def test_speedups(spark):
    rows = [("k", "a", 10_000.0, 1), ("k", "b", 8_000.0, 2), ("k", "b", 6_000.0, 3), ("k", "b", 99_000.0, 0), ("k", "b", 7_000.0, 4), ("j", "b", 5.0, 1)]
    df = spark.createDataFrame(rows, "key string, mode string, ms double, at long")
    got = {(r.key, r.mode): (r.median_ms, r.speedup) for r in perf.mode_speedups(df, ["key"], "mode", "ms", "a", 3, F.desc("at")).collect()}
    assert got == {("k", "a"): (10_000.0, 1.0), ("k", "b"): (7_000.0, 10 / 7), ("j", "b"): (5.0, None)}
    best = perf.best_modes(perf.mode_speedups(df, ["key"], "mode", "ms", "a", 3, F.desc("at")), ["key"], "median_ms")
    assert [(r.key, r.mode) for r in best.collect()] == [("k", "b")]


def test_history_is_bounded(spark):
    df = spark.range(100).selectExpr("id % 2 as key", "id as at")
    kept = perf.evicted(df, ["key"], 30, 40, F.desc("at")).collect()
    assert sorted(r["at"] for r in kept) == list(range(60, 100))
