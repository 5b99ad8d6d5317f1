import json

from pyspark.sql import functions as F

from shelfspark.sources import files
from shelfspark.sources.paged import PagedVectors


def test_walk(spark, tmp_path):
    for name in ("a/clip.MP4", "a/note.txt", "node_modules/x.txt", "a/.hidden/x.txt", "b/pic.png", "b/data.bin"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"12345")
    got = {r.relative_path: r for r in files.walk(spark, str(tmp_path), ("video", "document")).collect()}
    assert set(got) == {"a/clip.MP4", "a/note.txt"}
    assert got["a/clip.MP4"].kind == "video" and got["a/clip.MP4"].fingerprint.startswith("5:")


def test_plain_texts(spark, tmp_path):
    (tmp_path / "good.txt").write_text("a\r\nb")
    (tmp_path / "binary.txt").write_bytes(bytes([0, 1, 2, 3]))
    (tmp_path / "latin.txt").write_bytes("ü".encode("latin-1"))
    (tmp_path / "empty.md").write_text(" \n")
    (tmp_path / "pic.png").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.problem) for r in files.plain_texts(spark, str(tmp_path)).collect()}
    assert got == {"good.txt": ("a\nb", None), "binary.txt": (None, "binary"), "latin.txt": (None, "not UTF-8"), "empty.md": (None, "empty")}


def test_history(spark, tmp_path):
    good = {"version": 1, "workload_key": "w", "provider_key": "p", "elapsed_ms": 5, "concurrency": 1, "sampled_at_ms": 1}
    lines = [json.dumps(good), json.dumps(good | {"version": 2}), json.dumps(good | {"elapsed_ms": 0}), "broken"]
    (tmp_path / "h.json").write_text("\n".join(lines))
    assert files.history(spark, str(tmp_path / "h.json")).count() == 1


def test_caption_events(spark):
    payload = json.dumps({"events": [{"tStartMs": 1000, "dDurationMs": 500, "segs": [{"utf8": "a"}, {"utf8": "b"}]}, {"tStartMs": 1}]})
    rows = spark.createDataFrame([(payload,), ("no json",), (None,)], "p string").select(files.caption_events(F.col("p")).alias("c")).collect()
    assert [tuple(x) for x in rows[0].c] == [(1.0, 1.5, "ab")] and not rows[1].c and not rows[2].c
    assert {f["id"]: f["available"] for f in files.formats(pdf=True)} == {"plain": True, "word": False, "pdf": True}


def test_images(spark, tmp_path):
    (tmp_path / "small.png").write_bytes(b"x" * 10)
    (tmp_path / "large.png").write_bytes(b"x" * 100)
    (tmp_path / "note.txt").write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[-1] for r in files.images(spark, str(tmp_path), 50).collect()] == ["small.png"]


def test_paged_vectors(spark, tmp_path):
    folder = str(tmp_path)

    class Folder(PagedVectors):
        @classmethod
        def name(cls):
            return "folder_vectors"

        @staticmethod
        def connect():
            class Client:
                def shards(self, index):
                    return [0, 1]

                def page(self, index, shard, token, size):
                    at = token or 0
                    rows = [(f"{index}-{shard}-{k}", [float(k), 1.0], {"n": str(k)}) for k in range(at, min(at + size, 7))]
                    return rows, at + size if at + size < 7 else None

                def put(self, index, rows):
                    with open(f"{folder}/put-{rows[0][0]}", "w") as out:
                        out.write(str(len(rows)))

                def delete(self, index, keys):
                    with open(f"{folder}/delete-{keys[0]}", "w") as out:
                        out.write(",".join(keys))

            return Client()

    spark.dataSource.register(Folder)
    rows = spark.read.format("folder_vectors").option("index", "i").option("page_size", 3).load()
    assert rows.count() == 14 and {r.key for r in rows.where("metadata['n'] = '6'").collect()} == {"i-0-6", "i-1-6"}
    rows.coalesce(1).write.format("folder_vectors").option("index", "i").mode("append").save()
    rows.where("key = 'i-0-1'").coalesce(1).write.format("folder_vectors").option("index", "i").option("operation", "delete").mode("append").save()
    assert (tmp_path / "put-i-0-0").read_text() == "14" and (tmp_path / "delete-i-0-1").read_text() == "i-0-1"
