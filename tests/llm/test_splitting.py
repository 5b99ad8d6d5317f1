import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfspark.llm.splitting import PARAGRAPH, SENTENCE, RangeMax, segment_pieces, split_segment, split_text, text_pieces


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.data())
def test_range_maximum(values, data):
    table = RangeMax(np.array(values, np.int64), len(values))
    lo = data.draw(st.integers(0, len(values) - 1))
    hi = data.draw(st.integers(lo, len(values) - 1))
    assert table.over(lo, hi) == max(values[lo : hi + 1])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab,. \n。 é́", max_size=600))
def test_pieces_are_within_the_limit_and_overlap(text):
    pieces = list(split_text(text, 60, 10))
    body = text.strip()
    assert bool(pieces) == bool(body)
    if pieces:
        start = len(text) - len(text.lstrip())
        assert pieces[0][0] == start and pieces[-1][1] == len(text.rstrip())
        assert all(0 < b - a <= 60 for a, b, _ in pieces) and all(q[0] == p[1] - 10 for p, q in zip(pieces, pieces[1:], strict=False))
        assert (len(pieces) == 1) == (len(body) <= 60)


def test_the_strongest_boundary_is_taken_and_the_rightmost_of_equals():
    text = "a" * 40 + ". " + "b" * 3 + "\n\n" + "c" * 3 + ". " + "d" * 60
    (_, cut, strength), *_ = split_text(text, 60, 5)
    assert (cut, strength) == (47, PARAGRAPH)
    text = "a" * 40 + ". " + "b" * 5 + ". " + "c" * 60
    (_, cut, strength), *_ = split_text(text, 60, 5)
    assert (cut, strength) == (49, SENTENCE)
    family = "x" * 58 + "👩‍👩" + "y" * 60
    assert list(split_text(family, 60, 5))[0][1] not in (59, 60)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab,. \n\r。\u3000)é\u0301", max_size=900), st.integers(1, 40))
def test_cuts_do_not_depend_on_blocks(text, block):
    assert list(split_text(text, 60, 10, block=block)) == list(split_text(text, 60, 10, block=10**6))


def test_long_white_space_before_a_block():
    """Runs of white space longer than any block, with line ends in them or a sentence end before them."""
    rng = np.random.default_rng(3)
    parts = ["word ", "end. ", " " * 500, "\n" + " " * 300 + "\n", "x" * 90, ", ", ".) " + "\t" * 200]
    for _ in range(60):
        text = "".join(rng.choice(parts, 300))
        assert list(split_text(text, 400, 30, block=50)) == list(split_text(text, 400, 30, block=10**7))


def test_pieces_of_a_long_text_leave_as_they_are_cut(spark):
    """A text of several million characters beside short ones."""
    text = "Some words of a sentence, and more. " * 120_000
    got = text_pieces(spark.createDataFrame([(1, text, 7), (2, "short", 0)], "no long, t string, at long"), "no", "t", "at").select("record_no", "piece_no", "start_character", "end_character").collect()
    pieces = sorted(tuple(r)[1:] for r in got if r.record_no == 1)
    assert len(got) == len(pieces) + 1 and pieces == [(k, 7 + a, 7 + b) for k, (a, b, _) in enumerate(split_text(text), 1)]


def test_segments():
    assert split_segment(0, 60_000, 30_000) == [(0, 60_000, None)]
    pieces = split_segment(500, 200_000, 45_000)
    assert pieces[0] == (500, 45_000, 2) and pieces[-1][1] == 200_000
    assert all(b - a <= 60_000 for a, b, _ in pieces) and all(q[0] == p[1] - 2_000 for p, q in zip(pieces, pieces[1:], strict=False))
    assert len(split_segment(0, 30_000_000, None)) > 500


def test_tables(spark):
    long = "Sentence one goes here. " * 400
    rows = [(1, long, 100), (2, " \n short 　", 7), (3, None, 1), (4, "  \t", 1), (5, "😀" * 3600 + "\n" * 50, None), (6, "😀" * 3601, None), (1, long, 100)]
    df = spark.createDataFrame(rows, "chunk_no long, text string, start_character long").selectExpr("*", "'x' as record_no", "1 as base", "2 as lead")
    got = text_pieces(df, "chunk_no", "text", "start_character").collect()
    by = {n: sorted((r.start_character, r.end_character, r.text) for r in got if r.record_no == n) for n in range(1, 7)}
    assert by[2] == [(10, 15, "short")] and not by[3] and not by[4] and len(by[5]) == 1 and len(by[6]) == 2
    assert all(long[a - 100 : b - 100] == t for a, b, t in by[1]) and len(by[1]) % 2 == 0
    times = spark.createDataFrame([(1, 0, 60_000), (2, 0, 60_001), (3, None, 5), (4, 9, 3)], "n long, a long, b long")
    parts = segment_pieces(times, "n", F.col("a"), F.col("b"), F.lit(30_000)).collect()
    assert sorted((r.record_no, r.piece_no) for r in parts) == [(1, 1), (2, 1), (2, 2)]
    huge = spark.createDataFrame([(1, 0, 4_000_000_000)], "n long, a long, b long")
    assert segment_pieces(huge, "n", F.col("a"), F.col("b"), F.lit(30_000)).count() > 60_000
    assert text_pieces(df.limit(0), "chunk_no", "text", "start_character").collect() == []
