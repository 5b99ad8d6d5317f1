import random
import uuid

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import history
from shelfspark.llm.history import HashForest, entries_of, epoch_us, plain_path, plain_paths, plain_uuid, ranges, repeats
from shelfspark.session import as_table

HIT = "batch_no int, hit_no long, asset_path string, segment_index int, modified_at double"


def brute(rows):
    """(first_no, dup_no) by going through the rows in order."""
    accepted, out = {}, set()
    for _, no, path, segment, noted in sorted((r for r in set(rows) if None not in (r[0], r[1])), key=lambda r: r[:2]):
        name = plain_path(path)
        if name is None or segment is None or noted is None or noted != noted or noted <= 0:
            continue
        at = round(noted * 1e6 if noted < 1e11 else noted * 1e3 if noted < 1e14 else noted)
        for first, time in accepted.setdefault((name, segment), []):
            if abs(time - at) < 3_000_000:
                out.add((first, no))
                break
        else:
            accepted[name, segment].append((no, at))
    return out


def judged(spark, rows, extra=True):
    df = spark.createDataFrame(rows, HIT)
    if extra:
        df = df.selectExpr("*", "'x' as ident", "1 as tree", "2 as first_no", "3 as record_table")
    path = F.concat(F.col("segment_index").cast("string"), F.lit("\n"), plain_paths("asset_path"))
    entries = as_table(entries_of(df, "t", "batch_no", "hit_no", path, epoch_us(F.col("modified_at"))), "entries", ["batch_no"])
    batches = sorted({r[0] for r in rows if r[0] is not None})
    return repeats(spark, entries, batches)


def test_paths_of_one_file():
    same = ["/Volumes/A B/naïve.MP4", "file:///Volumes/A%20B/na%C3%AFve.MP4", "\\volumes\\a b\\naïve.mp4", "/Volumes//A B/./x/../naïve.mp4\r\n", "/Volumes/A B/naïve.mp4", "file://localhost/Volumes/A%20b/naïve.mp4", "/Volumes/A%20B/naïve.mp4%0D%0A", "file:///Volumes/A%20B/naïve.mp4%20"]
    assert len({plain_path(p) for p in same}) == 1
    assert len({plain_path(p) for p in ("/a/b.mp4", "/a/b (1).mp4", "/a/b_2.mp4", "/a/100%.mp4", "/a/100.mp4")}) == 5
    assert plain_path(None) is None and plain_path("  ") is None and plain_path("/..") is None


def test_uuids(spark):
    key = str(uuid.uuid4())
    forms = [key, key.upper(), "{" + key + "}", f"urn:uuid:{key}", f" {key}\n", key.replace("-", ""), "{" + key.upper() + "}"]
    others = [None, "", key[:-1], key[:-1] + "g", "x" + key]
    got = [r[0] for r in spark.createDataFrame([(f,) for f in forms + others], "k string").select(plain_uuid(F.col("k"))).collect()]
    assert got == [key.replace("-", "")] * len(forms) + [None] * len(others)


def test_prefixes_are_widened_until_they_hold_the_reach(spark):
    """Every range holds the reach, in one span of one of both trees; entries without time search one number."""
    span = 1 << history.SPAN_BITS
    at = [0, 1, 10**15, 400_000 * span - 1, 400_000 * span, 400_000 * span + 2_999_999, 400_000 * span + span // 2]
    rows = spark.createDataFrame([(5, t, True) for t in at] + [(6, 0, False)], "ident long, instant long, timed boolean")
    found = sorted((r.tree, r.low, r.high) for r in ranges(rows, history.TOLERANCE_US).collect())
    assert len(found) == 8 and (0, 0, 0) in found
    for tree, low, high in found:
        assert low // span == high // span and (high - low + 1) & (high - low) == 0
    for t in at:
        assert any(low - tree * span // 2 <= t - 2_999_999 and t + 2_999_999 <= high - tree * span // 2 for tree, low, high in found)
    assert {tree for tree, _, _ in found} == {0, 1}


def test_reach_follows_from_the_repeats_found(spark):
    forest = HashForest(spark, recall=0.9)
    assert forest.reach() == history.TOLERANCE_US
    forest.distances[10], forest.distances[21] = 1900, 100
    assert forest.reach() == 1 << 10
    forest.recall = 1.0
    assert forest.reach() == history.TOLERANCE_US


@pytest.mark.parametrize(("seed", "prune"), [(1, 2_000), (2, 0)])
def test_same_as_going_through_all_rows(spark, monkeypatch, seed, prune):
    monkeypatch.setattr(history, "PRUNE_LEADS", prune)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760" if prune else "-1")
    rng = random.Random(seed)
    base, rows = 1_700_000_000_000.0, []
    for no in range(500):
        path = rng.choice(["/a/X.mp4", "/A/x.mp4", "file:///a/x.mp4", "/b/y.mp4", f"/c/{no % 40}.mp4"])
        at = base + rng.choice([0, 0, 1000, 2000, 2999.999, 3000, 3001, 4500, 6000, rng.randrange(60_000)])
        noted = rng.choice([at, at, at * 1000, float(int(at / 1000)), 0.0, None, float("nan")]) if rng.random() < 0.3 else at
        rows.append((rng.randrange(1, 6), no, rng.choice([path, path, path, None]), rng.choice([0, 0, 1, None]), noted))
    rows += rows[:5]
    try:
        got = {(r.first_no, r.row_no) for r in judged(spark, rows).where("first_no is not null").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == brute(rows)


def test_chains_and_a_hot_file(spark):
    base = 1_700_000_000_000.0
    rows = [(1, i, "/hot.mp4", 0, base + 2000 * i) for i in range(12)] + [(2, 100 + i, "/HOT.mp4", 0, base + 2000 * (i % 12)) for i in range(60)]
    rows += [(2, 300 + i, "/copy.mp4", 1, base) for i in range(100)]
    got = {(r.first_no, r.row_no) for r in judged(spark, rows).where("first_no is not null").collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("backwards", [False, True])
def test_a_chain_over_several_spans(spark, monkeypatch, backwards):
    """A file saved every 2 s, reported in that order or against it, over blocks of 33 s."""
    monkeypatch.setattr(history, "SPAN_BITS", 25)
    base = 1_700_000_000_000.0
    rows = [(1 + i // 100, 300 - i if backwards else i, "/hot.mp4", 0, base + 2000 * i) for i in range(200)]
    got = {(r.first_no, r.row_no) for r in judged(spark, rows).where("first_no is not null").collect()}
    assert got == brute(rows)


def test_runs_are_merged_and_hold_accepted_entries_only(spark):
    base = 1_700_000_000_000.0
    rows = spark.createDataFrame([(b, 10 * b + i, f"/{i}.mp4", 0, base + 10_000 * b) for b in range(1, 10) for i in range(5)] + [(b, 900 + b, "/0.mp4", 0, base + 10_000) for b in range(2, 10)], HIT)
    entries = entries_of(rows, "t", "batch_no", "hit_no", plain_paths("asset_path"), epoch_us(F.col("modified_at")))
    forest = HashForest(spark)
    for number in range(1, 10):
        forest.ingest(entries.where(F.col("batch_no") == number))
    assert sorted(run.level for run in forest.runs) == [0, 1, 1]
    assert sum(run.rows for run in forest.runs) == 45
    held = forest.rows()
    assert held.select("row_no").distinct().count() == 45 == held.count()


def files_read(plan):
    """Rows that the scans of an executed plan gave out."""
    scans, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            scans += node.metrics().apply("numOutputRows").value()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return scans


def test_a_small_batch_reads_few_rows_however_long_the_history(spark, monkeypatch):
    """Ranges of a small batch select buckets and row groups, and larger histories have more of them."""
    monkeypatch.setattr(history, "BUCKET_ROWS", 1000)
    read = {}
    for size in (8_000, 64_000):
        forest = HashForest(spark)
        old = spark.range(size).selectExpr("'t' as record_table", "xxhash64(id) as ident", "hash(id) as proof", "1700000000000000 + id * 1000000 as instant", "true as timed", "1 as batch_no", "id as row_no")
        forest.add(old, size)
        new = old.where("row_no in (5, 77, 901, 4000)").selectExpr("record_table", "ident", "proof", "instant + 1 as instant", "timed", "2 as batch_no", "row_no + 1000000 as row_no")
        found = forest.candidates(new)
        assert "SelectedBucketsCount" in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.row_no for r in found.collect()) == [5, 77, 901, 4000]
        read[size] = files_read(found._jdf.queryExecution().executedPlan())
    assert 4 <= read[64_000] <= 1.5 * read[8_000] < 8_000


def test_history_is_not_shuffled(spark, monkeypatch):
    """Also a batch that is too large to be sent along meets the runs bucket by bucket."""
    monkeypatch.setattr(history, "PRUNE_LEADS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        forest = HashForest(spark)
        old = spark.range(1000).selectExpr("'t' as record_table", "xxhash64(id) as ident", "hash(id) as proof", "id * 1000000 as instant", "true as timed", "1 as batch_no", "id as row_no")
        forest.add(old, 1000)
        found = forest.candidates(old.withColumn("batch_no", F.lit(2)))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == plan.count("SortMergeJoin") > 0  # of each join only the batch moves
    assert found.select("row_no").distinct().count() == 1000


def test_empty_and_unknown(spark):
    assert judged(spark, [(1, 1, None, 0, 1.0), (1, 2, "/a", 0, None), (1, 3, "/a", None, 1e12)]).collect() == []
    empty = spark.createDataFrame([], HIT)
    entries = entries_of(empty, "t", "batch_no", "hit_no", plain_paths("asset_path"), None)
    assert repeats(spark, entries, []).collect() == []
