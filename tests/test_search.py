import pytest
from pyspark.sql import functions as F

from shelfspark.functions.paths import extension
from shelfspark.operators import search, store


def test_legacy_lane_fills_half(spark):
    rows = [(f"legacy-{i}", True, 0.9 - i / 100) for i in range(1, 5)] + [("live-a", False, 0.5), ("live-b", False, 0.4)]
    hits = spark.createDataFrame(rows, "id string, legacy boolean, score double")
    ids = lambda n: [r.id for r in search.capped_merge(hits, "legacy", "score", n, F.col("id")).collect()]
    assert ids(4) == ["legacy-1", "legacy-2", "live-a", "live-b"]
    assert ids(8) == ["legacy-1", "legacy-2", "legacy-3", "legacy-4", "live-a", "live-b"]


def test_best_passage_keeps_legacy_rows_apart(spark):
    rows = [("1", "/a.txt", "document", False, 0.5), ("2", "/a.txt", "document", False, 0.7), ("3", "/a.txt", "document", True, 0.6), ("4", "/v.mp4", "video", False, 0.1), ("5", "/v.mp4", "video", False, 0.2)]
    hits = spark.createDataFrame(rows, "id string, path string, kind string, legacy boolean, score double")
    best = search.best_passage(hits, F.col("path"), F.col("kind"), F.col("legacy"), F.col("id"), F.col("score"), F.col("id"))
    assert {r.id for r in best.collect()} == {"2", "3", "4", "5"}


def test_web_hits_take_text_from_losers(spark):
    rows = [("a", "s", "v", 1.2, 0, 0.9, ""), ("b", "s", "v", 1.9, 1, 0.8, "words"), ("c", "", "v", 1.0, 1, 0.3, "x"), ("d", "s", "v", 2.0, 0, 0.1, "")]
    hits = spark.createDataFrame(rows, "id string, site string, video string, start double, lane int, score double, text string")
    got = {r.id: r.text for r in search.web_dedupe(hits, F.col("site"), F.col("video"), F.col("start"), F.col("lane"), "score", "text", F.col("id")).collect()}
    assert got == {"a": "words", "c": "x", "d": ""}


def test_format_in_query_lifts_files(spark):
    rows = [(f"{i}.json", 0.48 - i / 100) for i in range(9)] + [("table.csv", 0.37), ("paper.pdf", 0.36)]
    hits = spark.createDataFrame(rows, "name string, score double")
    first = lambda q: search.with_lexical_boost(hits, F.lit(q), "name", extension(F.col("name")), "score").orderBy(F.desc("score")).first().name
    assert first("budget CSV") == "table.csv" and first("the PDF") == "paper.pdf" and first("json") == "0.json"


def test_top_k_filters_before_cutting(spark):
    rows = [(f"k{i:03}", "image", [0.9995 - i / 1000, 0.03]) for i in range(200)] + [("video", "video", [0.5, 0.5]), ("null", "video", None), ("zero", "video", [0.0, 0.0]), ("short", "video", [1.0]), ("nan", "video", [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "key string, kind string, vector array<float>")
    assert [r.key for r in search.top_k(df.where("kind = 'video'"), "vector", [1.0, 0.0], "key", 5).collect()] == ["video"]
    assert search.top_k(df.limit(0), "vector", [1.0, 0.0], "key").collect() == []
    assert search.bounded(10**6) == 500 and search.bounded(-1) == 1 and search.bounded(None) == 60


def test_many_queries_agree_with_one(spark):
    rows = spark.range(300).selectExpr("id", "case when id % 3 = 0 then 'a' else 'b' end as space", "array(cast(sin(id) as float), cast(cos(id * 7) as float), cast(id % 5 as float)) as vector")
    queries = rows.where("id in (3, 4)").selectExpr("id as query_no", "space", "vector")
    got = search.top_k_many(rows, "vector", "id", F.col("space"), queries, 3, 4).collect()
    for q in (3, 4):
        space, vector = [(r.space, r.vector) for r in queries.collect() if r.query_no == q][0]
        want = [r.id for r in search.top_k(rows.where(f"space = '{space}' and id <> {q}"), "vector", vector, "id", 4).collect()]
        assert [r.neighbour_no for r in sorted((r for r in got if r.query_no == q), key=lambda r: r["rank"])] == want
    many = rows.selectExpr("id as query_no", "space", "vector")
    whole = sorted(search.top_k_many(rows, "vector", "id", F.col("space"), many, 3, 4).select("query_no", "rank", "neighbour_no").collect())
    blocks = search.top_k_many(rows, "vector", "id", F.col("space"), many, 3, 4, block=40, cells=64).select("query_no", "rank", "neighbour_no")
    assert sorted(blocks.collect()) == whole and len(whole) == 4 * rows.where("id % 5 > 0 or sin(id) <> 0 or cos(id * 7) <> 0").count()


def test_rerank_order(spark):
    hits = spark.createDataFrame([(i, f"h{i}") for i in range(6)], "position int, id string")
    rated = spark.createDataFrame([(2, 0.9), (0, 0.1), (2, 0.3), (9, 1.0), (-1, 1.0), (4, 5.0)], "position int, relevance double")
    assert [r.id for r in search.reranked(hits, "position", rated, candidates=4).collect()] == ["h2", "h0", "h1", "h3", "h4", "h5"]


def test_store_round_trip(spark):
    shelf = store.VectorStore(spark)
    assert shelf.read("i", "s").collect() == [] and shelf.delete("i", "s", spark.createDataFrame([("x",)], "key string")) == 0
    rows = lambda values: spark.createDataFrame(values, "key string, vector array<float>, metadata map<string,string>, written_ms long")
    shelf.upsert("i", "s", rows([("one", [0.125, -0.5, 0.75], {"kind": "image"}, 1), ("two", [1.0, 0.0, 0.0], {"kind": "video"}, 1)]))
    shelf.upsert("i", "other", rows([("one", [9.0, 9.0], {}, 1)]))
    for n in range(3):
        shelf.upsert("i", "s", rows([("two", [0.0, 1.0, 0.0], {"kind": "video"}, 2 + n)]))
    assert {r.key: r.vector for r in shelf.read("i", "s").collect()} == {"one": [0.125, -0.5, 0.75], "two": [0.0, 1.0, 0.0]}
    image = store.metadata_filter({"kind": "image", "title": " "})
    assert [r.key for r in shelf.search("i", "s", [0.9, 0.1, 0.0], 1, image).collect()] == ["one"]
    assert shelf.read("i", "s", F.col("space") == "other").collect() == []
    for bad in ([("", [1.0, 0.0, 0.0], {}, 1)], [("x", [1.0], {}, 1)], [("x", [float("nan"), 0.0, 0.0], {}, 1)]):
        with pytest.raises(ValueError):
            shelf.upsert("i", "s", rows(bad))
    assert shelf.delete("i", "s", spark.createDataFrame([("one",), ("nope",), ("one",)], "key string")) == 1
    assert {(r.space, r["count"]) for r in shelf.counts().collect()} == {("s", 1), ("other", 1)}
    assert shelf.patch("i", "s", F.col("key") == "two", {"kind": "note", "title": "t"}, 9) == 1 and shelf.patch("i", "s", F.col("key") == "x", {"a": "b"}, 9) == 0
    assert [(r.metadata, r.written_ms, r.vector) for r in shelf.read("i", "s").collect()] == [({"kind": "note", "title": "t"}, 9, [0.0, 1.0, 0.0])]
    assert shelf.purge("i", "s", F.col("metadata.kind") == "note") == 1 and shelf.read("i", "s").count() == 0


def test_lookup_order(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, v int")
    asked = spark.createDataFrame([("c", 0), ("x", 1), ("a", 2), ("c", 3), ("", 4), (None, 5)], "key string, place int")
    assert [(r.key, r.asked_at) for r in store.lookup(rows, "key", asked, "place").orderBy("asked_at").collect()] == [("c", 0), ("a", 2)]
