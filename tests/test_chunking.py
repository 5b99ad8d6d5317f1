from hypothesis import given, settings
from hypothesis import strategies as st

from shelfspark.operators import chunking
from shelfspark.operators.chunking import MOST_CHUNKS, caption_chunks, document_chunks, windows


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n。", max_size=400))
def test_windows_cover_all_but_white_space(text):
    text = text.strip()
    found = windows(text, characters=50, overlap=10, most=1000)
    assert all(b - a <= 50 and text[a:b] == text[a:b].strip() for a, b in found)
    covered = {i for a, b in found for i in range(a, b)}
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)


def test_document_chunks(spark):
    sections = "\n\n".join(f"Section {i}. " + "words and more words. " * 8 for i in range(90)) + "\n\nthe unique tail"
    rows = [("long", sections), ("short", " short\r\n"), ("blank", " \n "), ("null", None), ("solid", "x" * 9000)]
    df = spark.createDataFrame(rows, "name string, text string").selectExpr("name", "text", "1 as key", "2 as chunk_index")
    got = document_chunks(df, "name", "text").collect()
    by = {n: sorted((r for r in got if r.key == n), key=lambda r: r.chunk_index) for n in ("long", "short", "blank", "null", "solid")}
    assert by["short"][0].text == "short" and not by["blank"] and not by["null"]
    assert len(by["long"]) > 1 and not by["long"][0].truncated and by["long"][-1].text.endswith("the unique tail")
    assert all(b.start_character < a.end_character for a, b in zip(by["long"], by["long"][1:], strict=False))
    assert [len(r.text) for r in by["solid"]] == [3600, 3600, 2440]
    cut = document_chunks(df, "name", "text", most=2).where("key = 'long'").collect()
    assert len(cut) == 2 and cut[0].truncated


def test_long_texts_are_chunked_to_their_end(spark, monkeypatch):
    text = ("A sentence of some words. " * 12_000)[:299_980] + " the very last words"
    df = spark.createDataFrame([("long", text), ("short", "short")], "name string, text string")
    got = sorted(document_chunks(df, "name", "text").where("key = 'long'").collect(), key=lambda r: r.chunk_index)
    assert len(text) == 300_000 and len(got) > MOST_CHUNKS and got[-1].end_character == len(text) and got[-1].text.endswith("the very last words")
    assert got[0].start_character == 0 and all(b.start_character <= a.end_character for a, b in zip(got, got[1:], strict=False)) and not any(r.truncated for r in got)
    assert [(r.start_character, r.end_character) for r in got] == windows(text) and all(r.text == text[r.start_character : r.end_character] for r in got)
    cut = document_chunks(df, "name", "text", most=MOST_CHUNKS).where("key = 'long'").collect()
    assert len(cut) == MOST_CHUNKS and all(r.truncated for r in cut)
    monkeypatch.setattr(chunking, "BATCH_CHARACTERS", 10_000)
    assert sorted(document_chunks(df, "name", "text").collect()) == sorted([*got, *document_chunks(df.where("name = 'short'"), "name", "text").collect()])


def test_captions(spark):
    cues = [("v", 0.0, 5.0, "one"), ("v", 6.0, 9.0, " two\nwords "), ("v", 26.0, 27.0, "three"), ("v", 7.0, 8.0, "  "), ("w", 0.0, 1.0, "x" * 200), ("w", 1.0, 2.0, "y"), (None, 0.0, 1.0, "z"), ("u", 5.0, 4.0, "back")]
    df = spark.createDataFrame(cues, "video string, start_seconds double, end_seconds double, caption string")
    got = {(r.video, r.chunk_index): (r.start_seconds, r.end_seconds, r.text[:9]) for r in caption_chunks(df).collect()}
    assert got == {("v", 0): (0.0, 9.0, "one two w"), ("v", 1): (26.0, 27.0, "three"), ("w", 0): (0.0, 1.0, "x" * 9), ("w", 1): (1.0, 2.0, "y"), ("u", 0): (5.0, 5.0, "back")}
