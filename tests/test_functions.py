import uuid

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from shelfspark.operators.search import with_lexical_boost
from shelfspark.functions import keys, media, paths, text, vectors
from shelfspark.functions.plugins import HashEmbedder, UnitEmbedder, embedding, read_documents, reranked_by


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)] if values else [Row(_=1)]).select(column.alias("x")).first()[0]


def test_uuid5_is_that_of_the_standard(spark):
    names = ["asset:/a/b.mp4:0:space", "", "街景 naïve", "x" * 500]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(keys.uuid5_url(F.col("n"))).collect()
    assert [r[0] for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


@pytest.mark.parametrize(("context", "frames"), [(32768, 148), (32560, 148), (32559, 147), (440, 2), (439, 1), (1, 1), (0, 148), (None, 148), (float("nan"), 148)])
def test_frame_budget(spark, context, frames):
    assert one(spark, media.frame_budget(F.lit(context).cast("double"))) == frames


def test_chunk_plan(spark):
    plan = lambda d, **k: one(spark, media.chunk_plan(F.lit(d).cast("double"), F.lit(32768), **k))
    assert len(plan(10.0).segments) == 1
    assert len(plan(31.0).segments) == 2
    assert plan(60.0, fps=10).chunk_seconds == 14
    stretched = plan(1000.0, most=10)
    assert stretched.chunk_seconds == 100 and stretched.stretched and stretched.loses_frames
    assert plan(90.5).segments[-1].end_seconds == 90.5
    assert plan(0.0) is None and plan(None) is None and plan(float("nan")) is None and plan(float("inf")) is None
    ends = plan(605.25).segments
    assert ends[0].start_seconds == 0 and all(a.end_seconds == b.start_seconds for a, b in zip(ends, ends[1:], strict=False))


def test_addresses(spark):
    stamp = lambda u, s: one(spark, media.stamped(F.lit(u), F.lit(s).cast("double")))
    assert stamp("https://a.test/watch?v=1", 42.9) == "https://a.test/watch?v=1&t=42s"
    assert stamp("https://a.test/watch?t=3s&v=1#x", 42.0) == "https://a.test/watch?v=1&t=42s#x"
    assert stamp("https://www.bilibili.com/video/BV1", 42.0) == "https://www.bilibili.com/video/BV1?t=42"
    assert stamp("ftp://a.test/x", 1.0) == ""
    assert one(spark, media.clock(F.lit(3725.9))) == "1:02:05" and one(spark, media.clock(F.lit(65.0))) == "1:05"
    assert one(spark, media.byte_size(F.lit(1536))) == "1.5 KB"
    assert one(spark, media.fitted(F.lit(1921), F.lit(1080))).width % 2 == 0


def test_storyboard_and_backoff(spark):
    levels = one(spark, media.storyboard(F.lit("https://x/$L|48#27#100#10#10#0#default#rs$a|80#45#60#5#5#2000#M$M#rs$b")))
    assert (levels[1].width, levels[1].interval_ms, levels[1].name) == (80, 2000, "M$M")
    assert one(spark, media.backoff_ms(F.lit(3))) == 40_000 and one(spark, media.backoff_ms(F.lit(50))) == 300_000


def test_text_forms(spark):
    assert one(spark, text.normalized_text(F.lit("  a\r\nb \t c \n\n\n\n\nd\x00e　"))) == "a\nb   c\n\n\nd e"
    assert one(spark, text.searchable_name(F.lit("Rough_Cut (1).MP4"))) == "rough cut 1"
    assert one(spark, text.searchable_name(F.lit("ＡＢ c.mov"))) == "ab c"
    assert one(spark, text.space_slug(F.lit("Elm Embedding-9b"), F.lit(4096), text.input_style(F.lit("elm-embedding-9b"), F.lit("auto"), "elm", "oak"), "v1")) == "elm-embedding-9b-4096-elm-v1"
    assert len(one(spark, text.messages(F.lit("elm"), F.lit("i"), F.lit("t"), "elm"))) == 1 and len(one(spark, text.messages(F.lit("oak"), F.lit("i"), F.lit("t"), "elm"))) == 2
    assert one(spark, text.preview(F.lit(" a \n b " * 200))).startswith("a b a b")


def test_lexical_boost(spark):
    boost = lambda q, n, e: with_lexical_boost(spark.createDataFrame([(n, 0.0)], "name string, score double"), F.lit(q), "name", F.lit(e), "score").first().boost
    assert boost("the rough cut please", "Rough-Cut.mp4", "mp4") == pytest.approx(0.18)
    assert boost("monthly budget csv", "report.csv", "csv") == pytest.approx(0.14)
    assert boost("docx文件", "report.docx", "docx") == pytest.approx(0.12)
    assert boost("csvs", "report.csv", "csv") == 0
    assert boost("final report draft", "report two.txt", "txt") == pytest.approx(0.08)
    assert boost("the rough cut please", "ＲＯＵＧＨ－ｃｕｔ．mp4", "mp4") == pytest.approx(0.18)
    assert boost("", "a.csv", "csv") == 0 and boost("csv report", "report.csv", "csv") == pytest.approx(0.22)


def test_paths(spark):
    p = F.lit("/a/node_modules/b/C.MP4")
    assert one(spark, paths.extension(p)) == "mp4" and one(spark, paths.kind_of(paths.extension(p))) == "video" and one(spark, paths.passed_by(p))
    assert one(spark, paths.ancestors(F.lit("/a/b/c"))) == ["/a", "/a/b", "/a/b/c"]
    assert one(spark, paths.inside(F.lit("/a/bc"), F.lit("/a/b"))) is False
    assert one(spark, paths.folder_label(F.lit("/x/Project/clips"))) == "Project/clips" and one(spark, paths.folder_label(F.lit("/x/Project"))) == "Project"


def test_keys(spark):
    assert one(spark, keys.fingerprint(F.lit(5), F.lit(-2.5))) == "5:-2"
    assert one(spark, keys.hamming(F.lit("ffffffffffffffff"), F.lit("0000000000000000"))) == 64 and one(spark, keys.hamming(F.lit("0f"), F.lit("0e"))) == 1
    assert one(spark, keys.hamming(F.lit(None).cast("string"), F.lit("0e"))) == 64
    same = one(spark, keys.collection_name(F.lit("images-a"), F.lit("s"))) == one(spark, keys.collection_name(F.lit("images_a"), F.lit("s")))
    assert not same


def test_vectors(spark):
    a = F.array(*[F.lit(x).cast("float") for x in (0.9, 0.1, 0.0)])
    b = F.array(*[F.lit(x).cast("float") for x in (1.0, 0.0, 0.0)])
    assert one(spark, vectors.cosine(a, b)) == pytest.approx(0.9 / (0.82**0.5), abs=1e-6)
    assert one(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    assert one(spark, vectors.usable(F.array(F.lit(1.0), F.lit(float("nan"))), 2)) is False and one(spark, vectors.usable(a, 3)) is True
    assert one(spark, vectors.score_of(F.lit(None).cast("double"))) == 1 and one(spark, vectors.score_of(F.lit(3.0))) == -1


def test_plugins(spark):
    rows = spark.createDataFrame([(0, "rough cut"), (1, None), (2, ""), (3, "rough cut")], "position int, text string")
    got = {r.position: r.v for r in rows.select("position", embedding(HashEmbedder(8))("text").alias("v")).collect()}
    assert got[0] == got[3] and got[1] is None and got[2] is None and sum(x * x for x in got[0]) == pytest.approx(1, abs=1e-6)
    assert rows.select(embedding(UnitEmbedder(2))("text").alias("v")).first().v == [1.0, 0.0]
    rated = reranked_by(lambda q, d: [len(x) for x in d], rows, "q", "text", "position", 3).collect()
    assert {(r.position, r.relevance) for r in rated} == {(0, 9.0), (1, 0.0), (2, 0.0)}
    assert reranked_by(lambda q, d: 1 / 0, rows, "q", "text", "position").collect() == []
    files = spark.createDataFrame([("/a.docx", b"body"), ("/b.pdf", b"x"), ("/c.zip", b"")], "path string, content binary")
    out = {r.path: (r.text, r.problem) for r in read_documents(files, {"docx": bytes.decode, "pdf": lambda b: 1 / 0}).collect()}
    assert out["/a.docx"] == ("body", None) and out["/b.pdf"][1] == "division by zero" and out["/c.zip"] == (None, "no reader")
