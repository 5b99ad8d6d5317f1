"""Splitting oversized items at natural boundaries (problem 2).

Every possible cut has a boundary strength. A sparse table over (strength, position) answers "the strongest cut in
this window, the rightmost among equals" in constant time. A piece ends at the strongest cut in the window of
permissible lengths; the next piece begins the overlap before that cut. Only items over the limit reach Python; the
others leave as one piece without being looked at.

Texts: lengths are code points, white space at either end does not count and is left out of the pieces. Cuts prefer,
in this order, blank lines, line ends, sentence ends, clause ends, white space, any other place that does not tear a
character from its marks, and last of all a torn one. Segments: cuts prefer the grid of the video's own chunk length,
then whole seconds; times are whole milliseconds.

Nulls: null and blank texts give no piece; segments whose start or end is missing, NaN or not after the start give no
piece. A null ``start_character`` counts as 0. Rows that come twice give their pieces twice. Empty input gives an empty
result. Strengths and table are made for at most ``BLOCK`` positions at a time, and what is known of the text before a
block goes on into it, so cuts do not depend on blocks. A task holds one text, one block and ``MOST_CHARACTERS`` of pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_LIMIT, TEXT_OVERLAP = 3600, 320
SEGMENT_LIMIT_MS, SEGMENT_OVERLAP_MS = 60_000, 2_000
#: A piece is at least this share of the limit, unless it is the last.
LEAST_SHARE = 0.6
BLOCK = 1 << 16
TIME_BLOCK = 1 << 20
#: Pieces that a task holds before it passes them on.
MOST_PIECES, MOST_CHARACTERS = 50_000, 1 << 24

PARAGRAPH, LINE, SENTENCE, CLAUSE, SPACE, PLAIN, TORN = 6, 5, 4, 3, 2, 1, 0

#: White space: what Python's ``str.isspace`` accepts.
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_BLANK_CODES = np.array([ord(c) for c in BLANKS], "<u4")

# The characters that end sentences and clauses.
_ENDS = ".!?…。！？｡"
_STOPS = "。！？｡"
_CLAUSES = ",;:，、；：—)）」』”]】"
_CLOSERS = "\"'”’)]）」』】"


class RangeMax:
    """Sparse table over int64 values: the largest value of any range in constant time."""

    def __init__(self, values: np.ndarray, widest: int) -> None:
        self.levels = [values]
        width = 1
        while 2 * width <= min(widest, len(values)):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[:-width], last[width:]))
            width *= 2

    def over(self, lo: int, hi: int) -> int:
        """Largest value at lo..hi, both included."""
        level = (hi - lo + 1).bit_length() - 1
        row = self.levels[level]
        return int(max(row[lo], row[hi + 1 - (1 << level)]))


class StrongestCut:
    """The strongest cut in a window of positions, rightmost among equals.

    ``candidates(lo, hi)`` gives the positions lo..hi - 1 at which a cut may stand, in order, and their strengths; the
    table is built over ``block`` positions at a time. Where a window holds no candidate, its end is cut with strength 0.
    """

    def __init__(self, candidates: Callable[[int, int], tuple[np.ndarray, np.ndarray]], end: int, widest: int, block: int = BLOCK) -> None:
        self.candidates, self.end, self.widest, self.block = candidates, end, widest, block
        self.lo = self.hi = 0
        self.table: RangeMax | None = None

    def between(self, lo: int, hi: int) -> tuple[int, int]:
        """(position, strength) for lo <= position <= hi."""
        if self.table is None or lo < self.lo or hi >= self.hi:
            self.lo, self.hi = lo, min(self.end, lo + max(self.block, hi - lo) + 1)
            self.at, strength = self.candidates(self.lo, self.hi)
            self.table = RangeMax(strength.astype(np.int64) << 32 | np.arange(len(strength)), self.widest)
        first, last = np.searchsorted(self.at, lo), np.searchsorted(self.at, hi, "right") - 1
        if first > last:
            return hi, 0
        best = self.table.over(int(first), int(last))
        return int(self.at[best & 0xFFFFFFFF]), best >> 32


def cut(start: int, end: int, limit: int, overlap: int, least: int, cuts: StrongestCut) -> Iterator[tuple[int, int, int | None]]:
    """Pieces (from, to, strength of the cut at ``to``) of start..end; each at most ``limit`` long, sharing ``overlap``."""
    while end - start > limit:
        at, strength = cuts.between(start + least, start + limit)
        yield start, at, strength
        start = at - overlap
    yield start, end, None


def _members(chars: np.ndarray, of: str) -> np.ndarray:
    return np.isin(chars, np.frombuffer(of.encode("utf-32-le"), "<u4"))


def read_from(chars: np.ndarray, at: int) -> int:
    """Where to read from so that the strengths from ``at`` on are those of the whole text: one before the last solid character, however far that is."""
    end, step = at, 256
    while end > 0:
        part = chars[max(0, end - step) : end]
        if len(solid := np.flatnonzero(~np.isin(part, _BLANK_CODES))):
            return max(0, end - len(part) + int(solid[-1]) - 1)
        end -= len(part)
        step *= 2
    return 0


def text_strengths(chars: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """Strength of the cut before each character of a text; ``blank`` tells the white space."""
    n = len(chars)
    out = np.full(n, PLAIN, np.uint8)
    if n < 2:
        return out
    before = np.concatenate(([True], blank[:-1]))
    newline = (chars == 10) | ((chars == 13) & np.concatenate((chars[1:] != 10, [True])))
    stop = _members(chars, _ENDS)
    last_solid = np.maximum.accumulate(np.where(blank, 0, np.arange(n)))
    solid_before = np.concatenate(([0], last_solid[:-1]))
    # a closing quote or bracket after the end of a sentence belongs to it
    closes = _members(chars, _CLOSERS)
    ended = stop | (closes & np.concatenate(([False], stop[:-1])))
    out[1:][_members(chars, _CLAUSES)[:-1]] = CLAUSE
    out[before] = np.maximum(out[before], SPACE)
    clause_space = before & _members(chars, _CLAUSES)[solid_before]
    out[clause_space] = CLAUSE
    out[before & ended[solid_before]] = SENTENCE
    out[1:][(_members(chars, _STOPS) | (closes & np.concatenate(([False], _members(chars[:-1], _STOPS)))))[:-1]] = SENTENCE
    lines = np.cumsum(newline)
    out[1:][newline[:-1]] = LINE
    seen = lines[:-1] - lines[solid_before[1:]]
    out[1:][newline[:-1] & (seen >= 2)] = PARAGRAPH
    # a cut stands before the solid text that follows, not inside the white space
    inside = blank & before
    inside[1:] &= ~newline[:-1]
    out[inside] = np.minimum(out[inside], SPACE)
    marks = ((chars >= 0x300) & (chars < 0x370)) | ((chars >= 0xFE00) & (chars < 0xFE10)) | (chars == 0x200D) | ((chars >= 0x1F3FB) & (chars < 0x1F400)) | ((chars >= 0x20D0) & (chars < 0x2100))
    torn = marks | np.concatenate(([False], chars[:-1] == 0x200D)) | ((chars == 10) & np.concatenate(([False], chars[:-1] == 13)))
    out[torn] = TORN
    out[0] = TORN
    return out


def split_text(text: str, limit: int = TEXT_LIMIT, overlap: int = TEXT_OVERLAP, least_share: float = LEAST_SHARE, block: int = BLOCK) -> Iterator[tuple[int, int, int | None]]:
    """Pieces of a text as (from, to, strength), offsets in code points of ``text``, one by one."""
    start, end = len(text) - len(text.lstrip()), len(text.rstrip())
    if start >= end:
        return
    least = max(overlap + 1, int(limit * least_share))
    if end - start <= limit:
        yield start, end, None
        return
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")

    def candidates(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        # one character more behind the block, as a CR before an LF is no line end of its own
        begin = read_from(chars, lo)
        part = chars[begin : hi + 1]
        return np.arange(lo, hi), text_strengths(part, np.isin(part, _BLANK_CODES))[lo - begin : hi - begin]

    yield from cut(start, end, limit, overlap, least, StrongestCut(candidates, end, limit - least + 1, block))


def segment_cuts(start_ms: int, end_ms: int, grid_ms: int | None, limit: int = SEGMENT_LIMIT_MS, overlap: int = SEGMENT_OVERLAP_MS, least_share: float = LEAST_SHARE) -> Iterator[tuple[int, int, int | None]]:
    """Pieces of a stretch of time, one by one. Strengths: 2 on the grid of the video's chunks, 1 on other whole seconds, 0 elsewhere."""
    least = max(overlap + 1, int(limit * least_share))

    def candidates(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(-(-lo // 1000) * 1000, hi, 1000)
        if grid_ms and grid_ms > 0:
            at = np.union1d(at, np.arange(-(-lo // grid_ms) * grid_ms, hi, grid_ms))
            return at, np.where(at % grid_ms == 0, 2, 1)
        return at, np.ones(len(at), np.int64)

    return cut(start_ms, end_ms, limit, overlap, least, StrongestCut(candidates, end_ms, limit + 2, TIME_BLOCK))


def split_segment(start_ms: int, end_ms: int, grid_ms: int | None, limit: int = SEGMENT_LIMIT_MS, overlap: int = SEGMENT_OVERLAP_MS) -> list[tuple[int, int, int | None]]:
    """All pieces of a stretch of time."""
    return list(segment_cuts(start_ms, end_ms, grid_ms, limit, overlap))


_TEXT_PIECES = "record_no long, piece_no int, start_character long, end_character long, cut_strength int, text string"
_SEGMENT_PIECES = "record_no long, piece_no int, start_ms long, end_ms long, cut_strength int"


def _text_task(limit: int, overlap: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_no", "piece_no", "start_character", "end_character", "cut_strength", "text"]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        out: list[list] = [[] for _ in names]
        size = 0
        for batch in batches:
            for row in range(batch.num_rows):
                no, base, text = (c[row].as_py() for c in batch.columns)
                for k, (a, b, s) in enumerate(split_text(text, limit, overlap), 1):
                    for column, value in zip(out, (no, k, base + a, base + b, s, text[a:b]), strict=True):
                        column.append(value)
                    size += b - a
                    if size >= MOST_CHARACTERS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
                        out, size = [[] for _ in names], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return run


def _segment_task(limit: int, overlap: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_no", "piece_no", "start_ms", "end_ms", "cut_strength"]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for no, start, end, grid in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, (a, b, s) in enumerate(segment_cuts(start, end, grid, limit, overlap), 1):
                    for column, value in zip(out, (no, k, a, b, s), strict=True):
                        column.append(value)
                    if len(out[0]) >= MOST_PIECES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
                        out = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return run


def trimmed(text: Column) -> Column:
    """A text without white space at its ends."""
    return F.btrim(text, F.lit(BLANKS))


def text_pieces(rows: DataFrame, record_no: str, text: str, start_character: str, limit: int = TEXT_LIMIT, overlap: int = TEXT_OVERLAP) -> DataFrame:
    """(record_no, piece_no, start_character, end_character, cut_strength, text): every text as pieces within the limit."""
    typed = rows.select(
        F.col(record_no).cast("long").alias("record_no"), F.coalesce(F.col(start_character).cast("long"), F.lit(0)).alias("base"), F.col(text).alias("text")
    ).where("text is not null")
    # the whole text is at least as long as the trimmed one, so most rows are told apart without trimming
    over = (F.length("text") > limit) & (F.length(trimmed(F.col("text"))) > limit)
    lead = F.length("text") - F.length(F.ltrim(F.col("text"), F.lit(BLANKS)))
    whole = (
        typed.where(~over)
        .select("record_no", "base", lead.alias("lead"), trimmed(F.col("text")).alias("text"))
        .where("length(text) > 0")
        .select(
            "record_no",
            F.lit(1).alias("piece_no"),
            (F.col("base") + F.col("lead")).alias("start_character"),
            (F.col("base") + F.col("lead") + F.length("text")).alias("end_character"),
            F.lit(None).cast("int").alias("cut_strength"),
            "text",
        )
    )
    return whole.unionByName(typed.where(over).mapInArrow(_text_task(limit, overlap), _TEXT_PIECES))


def segment_pieces(rows: DataFrame, record_no: str, start_ms: Column, end_ms: Column, grid_ms: Column, limit: int = SEGMENT_LIMIT_MS, overlap: int = SEGMENT_OVERLAP_MS) -> DataFrame:
    """(record_no, piece_no, start_ms, end_ms, cut_strength): every segment as pieces within the limit."""
    typed = rows.select(F.col(record_no).cast("long").alias("record_no"), start_ms.alias("start_ms"), end_ms.alias("end_ms"), grid_ms.alias("grid_ms")).where("end_ms > start_ms")
    over = (F.col("end_ms") - F.col("start_ms")) > limit
    whole = typed.where(~over).select("record_no", F.lit(1).alias("piece_no"), "start_ms", "end_ms", F.lit(None).cast("int").alias("cut_strength"))
    return whole.unionByName(typed.where(over).mapInArrow(_segment_task(limit, overlap), _SEGMENT_PIECES))
