import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm.neighbours import VISITED, Model, class_members, classes, most_similar, pairs_within, representative_pairs, usable


def data(seed=0, rows=3000):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, 64))
    base = centres[rng.integers(0, 30, rows)] + 0.8 * rng.normal(size=(rows, 64))
    for k in range(0, rows, 10):  # near copies and copies of other length
        base[k + 1] = base[k] + rng.choice([0.05, 0.2, 0.33]) * rng.normal(size=64)
        base[k + 2] = base[k] * 3
    base[5] = base[6] = base[7]
    return base.astype(np.float32)


def table(spark, values, space="a"):
    rows = [(i, space if i % 4 else "b", v.tolist()) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "record_no long, sp string, v array<float>").selectExpr("record_no as no", "sp", "v", "'x' as space", "1 as vector", "0 as list")


def brute(values, least):
    x = values.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    own = np.arange(len(x)) % 4 == 0
    s[own[:, None] != own] = -9
    return s, {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(s >= least, 1)), strict=True)}


@pytest.mark.parametrize("part_rows", [8192, 50])
def test_all_pairs(spark, part_rows):
    values = data()
    got = {tuple(r) for r in pairs_within(usable(table(spark, values), "no", "v", F.col("sp")), 0.95, part_rows).collect()}
    assert got == brute(values, 0.95)[1] and len(got) > 300


def test_spaces_in_blocks(spark):
    """More spaces than are searched at once are searched in blocks, with the same result."""
    values = data(2, 900)
    rows = [(i, f"s{i // 10 % 7}", v.tolist()) for i, v in enumerate(values)]
    vectors = usable(spark.createDataFrame(rows, "no long, sp string, v array<float>"), "no", "v", F.col("sp"))
    copies = classes(vectors)
    whole, blocks = (sorted(tuple(r)[:2] for r in representative_pairs(vectors, 0.9, copies, at_once=n).collect()) for n in (200, 2))
    assert whole == blocks and len(whole) > 10
    near, apart = (sorted(most_similar(vectors, lambda n: n % 50 == 0, 3, at_once=n).select("record_no", "rank", "neighbour_no").collect()) for n in (200, 2))
    assert near == apart and len(near) == 54


def test_recall_at_a_sixteenth_of_the_lists():
    """The lists of the 8 nearest of 128 centroids hold nine tenths of the neighbours and more."""
    values = data(3, 40_000)
    values /= np.linalg.norm(values, axis=1, keepdims=True)
    model = Model.train(values[::2], 180_000)
    own = model.distances(values).argmin(1)
    queries = np.arange(0, 40_000, 200)
    alike = values[queries] @ values.T
    alike[np.arange(len(queries)), queries] = -9
    best = np.argpartition(-alike, 10, axis=1)[:, :10]
    near = np.argsort(model.distances(values[queries]), axis=1)[:, :VISITED]
    assert len(model.centroids) == 128 and np.mean([np.isin(own[b], n).mean() for b, n in zip(best, near, strict=True)]) >= 0.9

def test_recall_of_the_most_similar(spark):
    values = data(1)
    found = most_similar(usable(table(spark, values), "no", "v", F.col("sp")), lambda n: n % 50 == 0, 10, part_rows=100).collect()
    s, _ = brute(values, 2)
    np.fill_diagonal(s, -9)
    queries = range(0, len(values), 50)
    right = sum(len({r.neighbour_no for r in found if r.record_no == q} & set(np.argsort(-s[q])[:10].tolist())) for q in queries)
    assert right / (10 * len(queries)) >= 0.9
    assert {r["rank"] for r in found} == set(range(1, 11)) and {r.record_no for r in found} == set(queries)


def test_groups_of_copies(spark):
    one, two = np.ones(64, np.float32), np.arange(64, dtype=np.float32)
    rows = [(i, "a", one.tolist()) for i in range(30)] + [(100, "a", (one + 0.01).tolist()), (101, "a", two.tolist()), (101, "a", two.tolist()), (102, "b", one.tolist())]
    vectors = usable(spark.createDataFrame(rows, "no long, sp string, v array<float>"), "no", "v", F.col("sp"))
    got = {tuple(r) for r in pairs_within(vectors, 0.95).collect()}
    assert got == {(a, b) for a in [*range(30), 100] for b in [*range(30), 100] if a < b}
    members = {tuple(r) for r in class_members(vectors).collect()}
    assert members == {(i, 0, 30) for i in range(30)} | {(100, 100, 1), (101, 101, 1), (102, 102, 1)}
    assert [tuple(r)[:2] for r in representative_pairs(vectors, 0.95, classes(vectors)).collect()] == [(0, 100)]


def test_unusable_rows(spark):
    nan, inf, fine = float("nan"), float("inf"), [1.0] * 64
    rows = [(1, "a", None), (2, "a", [0.0] * 64), (3, "a", fine[:48]), (4, "a", [nan] + fine[1:]), (5, "a", [inf] + fine[1:]), (6, None, fine), (7, "a", [None] + fine[1:]), (8, "a", [1e30] + [0.0] * 63), (9, "a", [2e30] + [1e-30] * 63), (10, "A", [1e30] + [0.0] * 63)]
    df = spark.createDataFrame(rows, "no long, sp string, v array<float>")
    assert {r.record_no for r in usable(df, "no", "v", F.col("sp")).collect()} == {8, 9, 10}
    assert {tuple(r) for r in pairs_within(usable(df, "no", "v", F.col("sp")), 0.95).collect()} == {(8, 9)}
    assert pairs_within(usable(df.limit(0), "no", "v", F.col("sp")), 0.95).collect() == []
    assert most_similar(usable(df.limit(0), "no", "v", F.col("sp")), lambda n: n > 0).collect() == []
