"""Chunks of documents, captions and media as table functions.

A chunk begins where the one before it was cut, so cutting a text is a fold over its characters; it runs in Arrow batches,
one text at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import collapsed, normalized_text

CHARACTERS, OVERLAP = 3600, 320
#: What the reference keeps of a text; only for who asks for it, by default texts are chunked whole.
MOST_CHUNKS = 64
#: Characters of chunks that are passed on as one batch, so that texts may be of any length.
BATCH_CHARACTERS = 1 << 24
#: Cuts are sought from this share of a chunk on.
SEARCH_FROM = 0.58
CUE_SECONDS, CUE_CHARACTERS = 25.0, 180

# Where a chunk may end besides blank lines. The blank behind a mark has to lie in the chunk's window, too.
_BLANK_LINE = re.compile(r"\n(?=\n)")
_MARK = re.compile(r"[。！？\n]")
_SPACED_MARK = re.compile(r"[.!?](?= )")
_SOLID = re.compile(r"\S")


class Boundaries:
    """All places of a text at which a chunk may end, by their strength and in order, found in one pass each.

    A place is the number of characters before it; its sign may need some of them, and room behind it.
    """

    def __init__(self, text: str) -> None:
        blank_lines = [found.start() + 2 for found in _BLANK_LINE.finditer(text)]
        marks = [found.end() for found in _MARK.finditer(text)]
        spaced = [found.end() for found in _SPACED_MARK.finditer(text)]
        #: Per strength the lists of places, each with the characters of its sign before the place and behind it.
        self.strengths = [[(blank_lines, 2, 0)], [(marks, 1, 0), (spaced, 1, 1)]]

    def last(self, low: int, high: int) -> int:
        """The last of the strongest places whose signs lie within low..high; ``high`` if there is none."""
        for lists in self.strengths:
            found = [places[at - 1] for places, sign, room in lists if (at := bisect_right(places, high - room)) and places[at - 1] >= low + sign]
            if found:
                return max(found)
        return high


def windows(text: str, characters: int = CHARACTERS, overlap: int = OVERLAP, most: int | None = None) -> list[tuple[int, int]]:
    """(from, to) of the chunks of a normalised text, without white space at their ends; the first ``most`` of them if that is given.

    Every chunk ends at the last of the strongest places in the rest of its window, and the next begins with the first
    character that is not white space from ``overlap`` characters before that place on.
    """
    places = Boundaries(text)
    chunks: list[tuple[int, int]] = []
    begin, end = 0, -1
    while end < len(text) and (most is None or len(chunks) < most):
        reach = begin + characters
        end = len(text) if reach >= len(text) else max(begin + 1, places.last(begin + int(characters * SEARCH_FROM), reach))
        if solid := _SOLID.search(text, begin, end):
            chunks.append((solid.start(), begin + len(text[begin:end].rstrip())))
        back = max(begin + 1, end - overlap)
        begin = solid.start() if (solid := _SOLID.search(text, back, end)) else end
    return chunks


def document_chunks(rows: DataFrame, key: str, text: str, characters: int = CHARACTERS, overlap: int = OVERLAP, most: int | None = None) -> DataFrame:
    """(key, chunk_index, start_character, end_character, text, truncated) of each text; null and blank texts give none.

    Texts are chunked to their end. With ``most`` (the reference has ``MOST_CHUNKS``) the rest is left out and ``truncated`` says so.
    """
    schema = "key string, chunk_index int, start_character int, end_character int, text string, truncated boolean"
    at_once = BATCH_CHARACTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            size = 0
            for name, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = windows(body, characters, overlap, most) if body else []
                for k, (a, b) in enumerate(found):
                    for column, value in zip(out, (name, k, a, b, body[a:b], found[-1][1] < len(body)), strict=True):
                        column.append(value)
                    size += b - a
                    if size >= at_once:
                        yield _document_batch(out)
                        out, size = [[] for _ in range(6)], 0
            yield _document_batch(out)

    # normalised once: with the short texts in a branch of their own, the expressions would run again in its filter and columns
    return rows.select(F.col(key).cast("string").alias("key"), normalized_text(F.col(text)).alias("text")).mapInArrow(run, schema)


def _document_batch(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["key", "chunk_index", "start_character", "end_character", "text", "truncated"])


class CaptionWindow:
    """Cues (start, end, text) joined until the window is too long in time or text; holds one window."""

    def __init__(self, seconds: float = CUE_SECONDS, characters: int = CUE_CHARACTERS) -> None:
        self.seconds, self.characters = seconds, characters
        self.cues: list[tuple[float, float, str]] = []
        self.size = 0

    def close(self) -> tuple[float, float, str] | None:
        """The open window, if there is one, and a new start."""
        if not self.cues:
            return None
        done = self.cues[0][0], max(self.cues[0][0], self.cues[-1][1]), " ".join(c[2] for c in self.cues)
        self.cues, self.size = [], 0
        return done

    def add(self, cue: tuple[float, float, str]) -> tuple[float, float, str] | None:
        """Takes a cue in; gives the window that it closes, if any."""
        late = bool(self.cues) and (cue[0] - self.cues[0][0] >= self.seconds or self.size + len(cue[2]) > self.characters)
        done = self.close() if late else None
        self.cues.append(cue)
        self.size += len(cue[2])
        return done


def caption_chunks(cues: DataFrame) -> DataFrame:
    """(video, chunk_index, start_seconds, end_seconds, text) from (video, start_seconds, end_seconds, caption).

    A window begins where the one before it ended, so the cues of a video are folded in the order of their starts; they
    stream through one task, which holds one window. Blank cues are dropped first.
    """
    schema = "video string, chunk_index int, start_seconds double, end_seconds double, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, index, window = None, 0, CaptionWindow()
        for batch in batches:
            out: list[tuple] = []
            for name, start, end, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != video:
                    if (done := window.close()) is not None:
                        out.append((video, index, *done))
                    video, index, window = name, 0, CaptionWindow()
                if (done := window.add((start, end, text))) is not None:
                    out.append((video, index, *done))
                    index += 1
            if out:
                yield _caption_batch(out)
        if (done := window.close()) is not None:
            yield _caption_batch([(video, index, *done)])

    plain = cues.select("video", F.col("start_seconds").cast("double"), F.col("end_seconds").cast("double"), collapsed(F.col("caption")).alias("caption"))
    known = plain.where("video is not null and caption <> '' and start_seconds is not null and end_seconds is not null")
    return known.repartition("video").sortWithinPartitions("video", "start_seconds", "end_seconds", "caption").mapInArrow(run, schema)


def _caption_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["video", "chunk_index", "start_seconds", "end_seconds", "text"])
