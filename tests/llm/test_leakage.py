import random

import pyarrow.parquet as pq
import pytest

from shelfspark.llm.leakage import GROUP_BLOCKS, build_index, leaks, words_of, worded_items


def found(spark, docs, items, **options):
    documents = docs if hasattr(docs, "columns") else spark.createDataFrame(docs, DOC)
    return leaks(build_index(documents, "doc_id", "text"), spark.createDataFrame(items, ITEM), "item_id", "text", **options).collect()

LEAD = "Read the passage and answer the question."
WORDS = [f"w{chr(97 + i % 26)}{i}" for i in range(900)]
ITEM, DOC = "item_id long, text string", "doc_id long, text string"


def passage(rng, n=60):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def chinese(rng, n=120):
    return "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))


@pytest.fixture(scope="module")
def case():
    rng = random.Random(11)
    items = [(i, f"{LEAD}\n{passage(rng)}") for i in range(8)] + [(i, f"阅读材料回答问题。\n{chinese(rng)}") for i in range(8, 14)]
    own = {i: t.split("\n", 1)[1] for i, t in items}
    prose = lambda: passage(rng, 200)
    half = own[3].split()[:32]
    edited = [("edit" if k % 9 == 4 else w) for k, w in enumerate(own[4].split())]
    docs = [
        (1, prose() + " " + own[0].upper() + ". " + prose()),
        (2, "<p>" + own[1].replace(" ", "&nbsp;\n<br/>") + "</p>"),
        (3, prose() + " " + " ".join(half) + " " + prose()),
        (4, " ".join(edited)),
        (5, prose() + " " + " ".join(own[5].split()[:11]) + " " + prose()),
        (6, LEAD + " " + prose()),
        (7, "\n".join(f"[00:0{k // 8}:{k % 60:02}] {own[9][k : k + 8]}" for k in range(0, len(own[9]), 8))),
        (8, prose() + own[10][:70] + chinese(rng, 60)),
        (9, own[0] + " " + own[6]),
        (10, own[0] + " " + own[6]),
        (11, None),
        (12, ""),
        (13, " ".join(w for pair in zip(own[7].split(), prose().split(), strict=False) for w in pair)),
        (14, ("x" * 50 + " ") * 3000 + own[2]),
    ]
    found = {(0, 1), (1, 2), (3, 3), (4, 4), (9, 7), (10, 8), (0, 9), (6, 9), (0, 10), (6, 10), (2, 14)}
    return items, docs, found


def test_finds_the_leaks(spark, case):
    items, docs, wanted = case
    documents = spark.createDataFrame(docs + docs[:1], DOC).selectExpr("*", "'x' as item_id", "1 as terms")
    got = found(spark, documents, [*items, (99, None), (98, "one two"), items[0]])
    assert {(r.item_id, r.doc_id) for r in got} == wanted and len(got) == len(wanted)
    whole = {(r.item_id, r.doc_id): r for r in got}[0, 1]
    assert whole.term_share == 1 and whole.covered_share == 1 and whole.longest_phrase == 60
    again = found(spark, documents, items, most_places=5)
    assert {(r.item_id, r.doc_id) for r in again} == wanted


def test_blocks_of_items_and_shards_change_nothing(spark, case):
    """Items beyond one block are searched in further blocks of the same index, which may have any number of shards."""
    items, docs, wanted = case
    index = build_index(spark.createDataFrame(docs, DOC), "doc_id", "text", 500, 40)
    assert index.where("low > high or size(terms) <> size(documents) or size(terms) > 40 or terms <> sort_array(terms)").count() == 0
    terms = index.selectExpr("sum(size(terms))").first()[0]
    assert terms > sum(len(t.split()) for _, t in docs if t and t.isascii()) / 2  # of all words, not of the test items only
    for block_chars in (1, 300, 10**9):
        got = leaks(index, spark.createDataFrame(items, ITEM), "item_id", "text", block_chars=block_chars).collect()
        assert {(r.item_id, r.doc_id) for r in got} == wanted and len(got) == len(wanted)


def test_row_groups_of_the_index_are_bounded(spark):
    """What a reader decodes at once does not grow with what a task has written."""
    index = build_index(spark.createDataFrame([(1, passage(random.Random(4), 3000))], DOC).coalesce(1), "doc_id", "text", 10**6, 10)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    sizes = [f.row_group(k).num_rows for f in files for k in range(f.num_row_groups)]
    assert sum(sizes) == 300 and max(sizes) <= GROUP_BLOCKS


def test_shared_leads_have_any_length(spark):
    lead = " ".join(f"lead{k}" for k in range(200))
    items = [(k, f"{lead} own{k} text") for k in range(5)] + [(7, lead), (8, f"{lead} own0")] + [(9, "lead0 lead1 other"), (10, "")]
    got = {r.item_id: r.lead for r in worded_items(spark.createDataFrame(items, ITEM), "item_id", "text").collect()}
    assert got == {**dict.fromkeys(range(5), 200), 7: 199, 8: 200, 9: 2}


def test_parts_in_any_order_and_far_apart(spark):
    """Two places 400 words apart, stretches of 12 words with insertions, halves that changed places."""
    rng = random.Random(15)
    own = passage(rng, 60).split()
    prose = lambda n=400: passage(rng, n)
    docs = [
        (1, " ".join(own[:21]) + " " + prose() + " " + " ".join(own[39:])),
        (2, " ".join(" ".join(own[k : k + 12]) + " " + prose(100) for k in range(0, 60, 12))),
        (3, " ".join(own[30:] + own[:30])),
        (4, prose()),
    ]
    got = {r.doc_id: r for r in found(spark, docs, [(1, " ".join(own))])}
    assert set(got) == {1, 2, 3} and got[3].term_share > 0.9 and got[2].term_share > 0.75


def test_short_items_and_items_in_several_places(spark):
    rng = random.Random(5)
    long, ten, three = passage(rng, 62).split(), passage(rng, 12).split(), passage(rng, 3)
    prose = lambda: passage(rng, 400)
    docs = [
        (1, f"{prose()} {' '.join(long[:16])} {prose()} {' '.join(long[31:47])} {prose()}"),
        (2, f"{prose()} {' '.join(ten[:6])} {prose()}"),
        (3, f"{prose()} {three} {prose()}"),
        (4, f"{prose()} {' '.join(long[:16])} {prose()}"),
        (5, " ".join(" ".join(prose().split()[:40] + long[k : k + 3]) for k in range(0, 60, 12))),
    ]
    # the rarest of the short item are the last in documents that hold its beginning: half of it has one rare term
    docs += [(10 + k, " ".join(ten[:5])) for k in range(3)]
    items = [(1, " ".join(long)), (2, " ".join(ten)), (3, three)]
    got = found(spark, docs, items)
    assert {(r.item_id, r.doc_id) for r in got} == {(1, 1), (2, 2), (3, 3)}
    whole = {r.item_id: r for r in got}[1]
    assert whole.term_share == 28 / 60 and whole.longest_phrase == 16


def test_empty_tables(spark, case):
    items, docs, _ = case
    assert found(spark, [], items) == [] == found(spark, docs, [])


def test_plain_words():
    assert words_of("A&amp;B <b>Ｃ</b> [00:01:02] naïve 街景x") == ["a", "b", "c", "naïve", "街", "景", "x"]
