import pytest
from pyspark.sql import functions as F

from shelfspark.llm.mixing import budgets, histogram, plain_source, selection, shares, sized, thresholds

TARGET = "mix_id string, source string, target_share double, max_repeats int, budget_ratio double"


@pytest.fixture(scope="module")
def sizes(spark):
    docs = spark.range(6000).selectExpr(
        "id as doc_id",
        "case when id % 3 = 0 then ' Web-Page' when id % 3 = 1 then 'web_page' when id % 30 = 2 then 'NOTE' when id % 30 = 5 then null else 'chat log' end as source",
        "case when id % 11 = 0 then null when id % 11 = 1 then '' else repeat('some words here ', cast(1 + id % 7 as int)) end as text",
        "'x' as tokens",
        "1 as hash",
    )
    return sized(docs.unionByName(docs.limit(3)), "doc_id", "text", "source")


def plan(targets, sizes):
    buckets = histogram(sizes)
    return thresholds(budgets(targets, buckets), sizes, buckets)


def test_spellings(spark):
    rows = spark.createDataFrame([(" Web-Page",), ("web page",), ("WEB_PAGE ",), ("",), (None,)], "s string")
    assert [r[0] for r in rows.select(plain_source(F.col("s"))).collect()] == ["web_page"] * 3 + [None, None]


def test_mix_meets_its_targets(spark, sizes):
    rows = [("m", "web-page", 0.5, 1, 0.4), ("m", "note", 0.3, 9, 0.4), ("m", "chat_log", 0.2, 1, 0.4), ("short", "note", 0.9, 2, 1.0), ("short", "absent", 0.1, 2, 1.0), ("nulls", "note", None, None, None)]
    planned = plan(spark.createDataFrame(rows, TARGET), sizes)
    report = {(r.mix_id, r.source): r for r in shares(planned, sizes).collect()}
    total = sizes.agg(F.sum("tokens")).first()[0]
    assert {k for k, r in report.items() if r.short} == {("short", "note"), ("short", "absent")}
    for key in (("m", "web-page"), ("m", "note"), ("m", "chat_log")):
        row = report[key]
        assert row.budget == pytest.approx(row.target_share * 0.4 * total)
        assert 0 <= row.budget - row.tokens_taken <= 60 and abs(row.reached_share - row.target_share) < 0.01
    assert report["m", "note"].copies >= 1
    note = sizes.where("source = 'note'").agg(F.sum("tokens")).first()[0]
    assert report["short", "note"].tokens_taken == 2 * note and report["short", "absent"].tokens_taken == 0 and report["nulls", "note"].tokens_taken == 0
    taken = selection(planned, sizes)
    assert taken.where("mix_id = 'm'").agg(F.max("times")).first()[0] <= 9
    assert {(r.mix_id, r.source): r.t for r in taken.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("times")).alias("t")).collect()}["m", "note"] == report["m", "note"].tokens_taken


def test_selections_nest(spark, sizes):
    rows = [("less", "web_page", 1.0, 1, 0.1), ("more", "web_page", 1.0, 1, 0.3)]
    taken = selection(plan(spark.createDataFrame(rows, TARGET), sizes), sizes)
    ids = {m: {r.doc_id for r in taken.where(F.col("mix_id") == m).collect()} for m in ("less", "more")}
    assert ids["less"] and ids["less"] < ids["more"]


def test_empty(spark, sizes):
    targets = spark.createDataFrame([("m", "note", 1.0, 1, 0.5)], TARGET)
    none = sizes.limit(0)
    assert [(r.short, r.tokens_taken) for r in shares(plan(targets, none), none).collect()] == [(False, 0)]
    assert shares(plan(targets.limit(0), sizes), sizes).collect() == []
