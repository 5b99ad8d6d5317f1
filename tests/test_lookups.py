import random
from statistics import median

from pyspark.sql import functions as F

from shelfspark.functions.keys import set_token
from shelfspark.operators.library import sidecars
from shelfspark.operators.perf import exact_medians
from shelfspark.sources.files import plain_texts


def test_tokens_do_not_depend_on_order_and_tell_sets_apart(spark):
    rows = [("a", "x"), ("a", "y"), ("b", "y"), ("b", "x"), ("c", "x"), ("d", "x"), ("d", "z")]
    token = {r.v: r.t for r in spark.createDataFrame(rows, "v string, k string").groupBy("v").agg(set_token(F.col("k")).alias("t")).collect()}
    assert token["a"] == token["b"] and len({token["a"], token["c"], token["d"]}) == 3


def nearest(paths, partners):
    """The nearest text file of the same stem by going through all pairs."""
    out = {}
    for path in set(paths):
        folder, _, name = path.rpartition("/")
        best = []
        for partner in set(partners) - {path}:
            other, _, other_name = partner.rpartition("/")
            if other_name.rpartition(".")[0].lower() == name.rpartition(".")[0].lower():
                a, b = folder.split("/"), other.split("/")
                shared = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
                best.append((len(a) + len(b) - 2 * shared, partner))
        if best:
            out[path] = min(best)
    return out


def test_a_stem_that_many_files_share(spark):
    """Readmes everywhere: the nearest of each, also for a text file that would be its own partner."""
    folders = ["/r", "/r/a", "/r/a/b", "/r/a/b/c", "/r/d", "/r/d/e", "/s", "/s/a"]
    paths = [f"{f}/readme.{e}" for f in folders for e in ("mp4", "txt")] + [f"/r/x{k}/y/readme.mov" for k in range(30)] + ["/r/d/other.mp4", "/r/other.txt", "/r/d/alone.mp4"]
    partners = ["/r/a/readme.txt", "/r/a/b/c/readme.txt", "/r/d/readme.srt", "/r/d/e/readme.txt", "/s/readme.md", "/r/other.txt", "/r/a/readme.txt"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: (r.steps, r.partner) for r in sidecars(files, spark.createDataFrame([(p,) for p in partners], "path string")).collect()}
    kept = [p for p in partners if p.rpartition(".")[2] in ("txt", "srt", "md")]
    assert got == nearest(paths, kept)


def test_binary_files_are_told_by_a_nul(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"text")
    (tmp_path / "b.txt").write_bytes(b"te\x00xt")
    (tmp_path / "c.txt").write_bytes(b"p0 00 \xc3\xb0")
    assert {r.path.rpartition("/")[2]: r.problem for r in plain_texts(spark, str(tmp_path)).collect()} == {"a.txt": None, "b.txt": "binary", "c.txt": None}


def test_exact_medians_of_groups_of_any_size(spark):
    rng = random.Random(4)
    groups = {"hot": [rng.lognormvariate(3, 2) for _ in range(20_000)], "ties": [5.0] * 300 + [1.0] * 299 + [9.0], "even": [1.0, 2.0, 3.0, 10.0], "one": [7.0], "two": [1.0, 4.0], None: [3.0, 1.0, 2.0]}
    groups |= {f"n{n}": [float(rng.randrange(50)) for _ in range(n)] for n in range(995, 1006)}
    rows = [(k, v) for k, values in groups.items() for v in values] + [("hot", None), ("hot", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double").selectExpr("k", "v", "1 as count", "2 as b")
    got = {r.k: (r.m, r["count"]) for r in exact_medians(df, ["k"], F.col("v"), "m").collect()}
    assert got == {k: (median(values), len(values)) for k, values in groups.items()}
    assert exact_medians(df.limit(0), ["k"], F.col("v"), "m").collect() == []
