from pyspark.sql import functions as F

from shelfspark.functions.plugins import HashEmbedder
from shelfspark.operators.store import VectorStore
from shelfspark.plans.profile import Profile, with_path
from shelfspark.plans.scan import scan


def test_scan(spark):
    store = VectorStore(spark)
    long = "A sentence of some words. " * 400
    disk = lambda rows: spark.createDataFrame(rows, "root string, path string, fingerprint string")
    texts = lambda rows: spark.createDataFrame(rows, "path string, text string")
    run = lambda f, t, **k: scan(store, "i", "s", "/r", disk(f), texts(t), HashEmbedder(8), **k)
    files = [("/r", "/r/a.txt", "1:1"), ("/r", "/r/b.txt", "1:1"), ("/r", "/r/c.txt", "1:1"), ("/q", "/q/x.txt", "1:1")]
    bodies = [("/r/a.txt", "some text"), ("/r/b.txt", long), ("/r/c.txt", " ")]
    assert run(files, bodies, dry_run=True).taken_in == 3 and store.read("i", "s").count() == 0
    first = run(files, bodies, most_files=2)
    assert (first.discovered, first.taken_in, first.remaining) == (3, 2, 1) and first.vectors == store.read("i", "s").count() > 3
    again = run(files, bodies)
    assert (again.skipped, again.taken_in, again.vectors) == (2, 1, 0)
    changed = run([("/r", "/r/b.txt", "2:2")], [("/r/b.txt", "now short")])
    assert (changed.removed, changed.vectors) == (1, 1)
    assert [r.metadata["text_preview"] for r in store.read("i", "s").collect()] == ["now short"]


class NoVectorFor(HashEmbedder):
    """No vector for texts that begin with a word."""

    def __init__(self, word):
        super().__init__(8)
        self.word = word

    def embed(self, texts):
        return super().embed(texts) * [[not t.startswith(self.word)] for t in texts]


def test_scan_passes_files_without_chunks(spark):
    store = VectorStore(spark)
    disk = lambda rows: spark.createDataFrame([("/r", f"/r/{p}", f) for p, f in rows], "root string, path string, fingerprint string")
    texts = lambda rows: spark.createDataFrame([(f"/r/{p}", t) for p, t in rows], "path string, text string")
    run = lambda f, t, e=NoVectorFor("odd"), **k: scan(store, "i", "s", "/r", disk(f), texts(t), e, **k)
    stored = lambda: sorted(r.metadata["path"][3:] for r in store.read("i", "s").collect())
    files = [(p, "1:1") for p in ("a-blank", "b-null", "c-video", "d-odd", "e", "f")]
    bodies = [("a-blank", " "), ("b-null", None), ("d-odd", "odd text"), ("e", "some text"), ("f", "other text")]
    first = run(files, bodies, most_files=4)
    assert (first.taken_in, first.incomplete, first.remaining, first.vectors) == (1, 3, 2, 0) and stored() == []
    second = run(files, bodies, most_files=2)
    assert (second.skipped, second.taken_in, second.remaining, stored()) == (3, 2, 1, ["e", "f"])
    third = run(files, bodies)
    assert (third.skipped, third.taken_in, third.incomplete) == (5, 0, 1)
    # a text that comes later and an embedder that has a vector now: nothing is passed by for good
    late = run(files, [*bodies, ("c-video", "captions")], HashEmbedder(8))
    assert (late.skipped, late.taken_in, late.incomplete) == (4, 2, 0) and stored() == ["c-video", "d-odd", "e", "f"]
    # rewritten to blank, or to something without a text: the old chunks go
    blank = run([*files[:4], ("e", "2:2"), ("f", "2:2")], [*bodies[:3], ("c-video", "captions"), ("e", "\n"), ("f", None)])
    assert (blank.skipped, blank.taken_in, blank.incomplete, blank.removed) == (4, 1, 1, 0) and stored() == ["c-video", "d-odd"]
    # rows that were deleted from the store are pending, and a recorded file that is gone is forgotten
    store.purge("i", "s", F.col("metadata.path") == "/r/d-odd")
    back = run(files[3:4], bodies, HashEmbedder(8))
    assert (back.taken_in, back.removed) == (1, 1) and stored() == ["d-odd"] and store.files("i", "s").count() == 1


def test_profile():
    profile = Profile.load('{"model": "m", "dimension": "x", "api_key": "k", "most_assets": -1, "video": {"chunk_seconds": 90, "fps": true}}')
    assert (profile.model, profile.dimension, profile.most_assets, profile.video.chunk_seconds, profile.video.longest_seconds, profile.video.fps) == ("m", 4096, 400, 90, 90, 2)
    assert profile.updated({"api_key": ""}).api_key == "k" and profile.public()["api_key"] == ""
    assert Profile.load("no json") == Profile()
    assert with_path({"a": {"b": 1}}, "a.c", "2.5") == {"a": {"b": 1, "c": 2.5}} and with_path({}, "x", "true") == {"x": True}
