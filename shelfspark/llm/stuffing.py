"""Keyword-stuffed and link-list pages (problem 8).

A page is read as units, cut at ends of sentences, blank lines and signs that stand by themselves between words. What
clause structure a unit has is told by its punctuation, its length and how its words repeat, so no language is known:

* A unit is a clause if it ends like a sentence and has between 5 and 60 words, of which few are numbers or addresses.
  Running text without punctuation is one if its stretches of 20 words have what running text has in any alphabet: a
  quarter of short words, of at least four kinds, few numbers and few words twice.
* Every other unit is loose: list items, tags, products, links, headings, code.
* A clause is crowded if one word (a pair of characters in scripts without spaces) stands in it three times or more and
  makes up much of it.

The suffix automaton of the page, over its characters, gives for each position the longest string that ends there and
stands in the page more than once; the union of these maximal repeats is what the page repeats. A crowded clause is
stuffed if repeats of ``LONG`` characters and more cover half of it. A page is spam if most of its characters lie in loose
or stuffed units, and enough of those characters lie in repeats of ``SHORT`` characters and more. So texts without
clauses that do not repeat themselves are no spam, nor are texts of clauses however often they repeat themselves.

The automaton is built only where loose and crowded units make up most of the page: no other page can be spam, as stuffed
units are crowded. A page is not read on once its clauses make up more than the rest can. On pages of more than
``STRETCH`` characters the same repeats are found without the automaton, which would take some hundred bytes for each.
Time marks, the counters of subtitles, marks at the beginning of lines, tags without address and entities are layout.

Null, empty and blank texts are no spam. Each page is looked at by itself and whole, whatever its length; rows that come
twice come out twice. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 0.5
#: Share of the loose and stuffed characters that must be repeated, where words are alphabetic and where they are not.
REPEATED, REPEATED_CJK = 0.25, 0.5
#: Characters of a repeat that counts, and of one that makes a crowded clause stuffed; alphabetic and not.
SHORT, SHORT_CJK, LONG, LONG_CJK = 6, 3, 16, 6
#: Share of characters of scripts without spaces from which their short repeats count, as words of a few characters stand among names.
MIXED = 0.05
#: Share of a crowded clause that its word makes up.
CROWDED = 0.12
LEAST_WORDS, MOST_WORDS, RUNNING = 5, 60, 20
#: Characters of a page up to which it gets an automaton; what is marked is the same beyond.
STRETCH = 1 << 17
#: Characters of scripts without spaces for one word.
PER_WORD = 1.6

_CJK = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_FIRST_CJK = "\u3040"
_MARKS = re.compile(r"[\[(]?\b\d{1,2}(?::\d\d){1,2}(?:[.,]\d{1,3})?\b[\])]?(?:\s*-->\s*)?|^\s*\d+\s*$", re.M)
_LEAD = re.compile(r"^[ \t]*[>#*\u2022+-]+[ \t]+", re.M)
_TAG = re.compile(r"<[^<>]*>")
_LINK = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+", re.I)
_ADDRESS = re.compile(_LINK.pattern + r"|(?<![a-z0-9-])[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}(?:/[^\s<>\"')\]]*)?")
#: Where units end: after a sentence, at a blank line, at a sign by itself.
_END = re.compile(rf"[.!?\u2026][\"'\u201d\u2019\xbb)\]]*(?=[\s{_CJK}])|[\u3002\uff01\uff1f]|\n\s*\n|[ \t]+[^\w\s.,;:!?\u2026'\"\u201c\u201d\u2018\u2019()\[\]/&%+$\u20ac\xa3\xa5-][ \t]+")
_CLOSED = re.compile(r"[.!?\u2026\u3002\uff01\uff1f][\"'\u201d\u2019\xbb)\]\u300d\u300f\uff09]*\s*$")
_WORD = re.compile(f"[{_CJK}]|[^\\W_{_CJK}]+")
#: Signs that stand beside words.
_SIGNS = str.maketrans(dict.fromkeys(".,;:!?\"()[]'/-", " "))
#: White space that is left when compatibility forms are folded.
_BLANKS = " \n\t\r\v\f\x1c\x1d\x1e\x1f\x85\u1680\u2028\u2029"
_BLANK_CODES = np.array([ord(c) for c in _BLANKS], "<u4")
#: Stands for the characters of addresses.
_HOLE = "\x01"

CLAUSE, LOOSE, CROWDED_CLAUSE = 0, 1, 2


def layout(text: str) -> str:
    """The text without its layout, in lower case."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(lambda tag: " ".join(["", *_LINK.findall(tag.group()), ""]), text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if ":" in text:
        text = _MARKS.sub(" ", text)
    return _LEAD.sub(" ", text.lower())


def repeats(tokens: Sequence[str]) -> np.ndarray:
    """Per position, the length of the longest string that ends there and stands in the tokens more than once.

    Builds the suffix automaton. The state of a prefix holds the strings that end where the prefix ends and nowhere else,
    unless states hang on it; its suffix link leads to the longest one that also ends elsewhere.
    """
    n = len(tokens)
    moves: list[dict[str, int]] = [{}] * (2 * n + 1)
    moves[0] = {}
    link, length = [0] * (2 * n + 1), [0] * (2 * n + 1)
    link[0] = -1
    ends = [0] * n
    last = new = 0
    for at, token in enumerate(tokens):
        new += 1
        state, last = last, new
        ends[at] = new
        moves[new] = {}
        length[new] = at + 1
        while state != -1:
            move = moves[state]
            target = move.setdefault(token, last)
            if target != last:
                reach = length[state] + 1
                if length[target] == reach:
                    link[last] = target
                else:
                    new += 1
                    moves[new] = moves[target].copy()
                    length[new] = reach
                    link[new] = link[target]
                    link[target] = link[last] = new
                    while state != -1 and (move := moves[state]).get(token) == target:
                        move[token] = new
                        state = link[state]
                break
            state = link[state]
    inner = set(link)
    return np.array([length[end] if end in inner else length[link[end]] for end in ends], np.int64)


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Positions inside a repeat of at least ``least`` tokens."""
    n = len(longest)
    at = np.arange(n)
    begins = np.where(longest >= least, at - longest + 1, n)
    return np.minimum.accumulate(begins[::-1])[::-1] <= at


def windows(codes: np.ndarray, least: int) -> np.ndarray:
    """``covered(repeats(codes), least)`` in some thirty bytes for each code.

    Each repeat of more than ``least`` is made of repeats of just ``least``, so what stands twice of that length is marked.
    Equal strings get equal numbers, from those of two shorter ones that overlap or touch.
    """
    inside = np.zeros(len(codes), bool)
    if len(codes) <= least:
        return inside
    numbers, length = codes.astype(np.int32), 1
    while length < least:
        step = min(length, least - length)
        pairs = numbers[:-step].astype(np.int64)
        pairs <<= 32
        pairs |= numbers[step:]
        order = np.argsort(pairs)
        pairs = pairs[order]
        numbers = np.zeros(len(order), np.int32)
        numbers[order[1:]] = np.cumsum(pairs[1:] != pairs[:-1], dtype=np.int32)
        length += step
    twice = np.bincount(numbers)[numbers] > 1
    for k in range(least):
        inside[k : k + len(twice)] |= twice
    return inside


def _is_crowded(words: list[str], size: int, wide: bool) -> bool:
    if wide:
        words = [a + b for a, b in zip(words[:-1], words[1:], strict=True) if a >= _FIRST_CJK and b >= _FIRST_CJK]
    if len(words) - len(set(words)) < 2:
        return False
    counts = Counter(w for w in words if wide or len(w) > 3)
    return any(n > 2 and n * len(w) >= CROWDED * size for w, n in counts.most_common(3))


def _runs(tokens: list[str]) -> bool:
    """Whether most stretches of the tokens look like running text."""
    stretches = [tokens[k : k + RUNNING] for k in range(0, len(tokens) - RUNNING + 1, RUNNING)]
    running = 0
    for stretch in stretches:
        words = list(filter(str.isalpha, stretch))
        short = [w for w in words if len(w) < 4]
        fine = len(words) >= 0.8 * RUNNING and len(short) >= 0.25 * RUNNING and len(set(short)) > 3 and len(set(stretch)) >= 0.7 * RUNNING
        running += fine and not _is_crowded(words, sum(map(len, stretch)), False)
    return running >= 0.6 * len(stretches)


def units(text: str) -> Iterator[tuple[int, int, int]]:
    """(from, to, kind) of the units of a text without layout, in order."""
    at = 0
    for found in _END.finditer(text):
        yield at, found.end(), _kind(text[at : found.end()])
        at = found.end()
    yield at, len(text), _kind(text[at:])


def _kind(unit: str) -> int:
    if "." in unit[:-1]:
        unit = _ADDRESS.sub(lambda found: _HOLE * len(found.group()), unit)
    bare = unit.translate(_SIGNS)
    spaced = bare.split()
    # most units are plain sentences, which are told without taking their words apart
    latin = not bare or max(bare) < _FIRST_CJK
    if LEAST_WORDS <= len(spaced) <= MOST_WORDS and latin and len(spaced) - len(set(spaced)) < 2 and _HOLE not in unit and sum(map(str.isalpha, spaced)) >= 0.8 * len(spaced) and _CLOSED.search(unit):
        return CLAUSE
    tokens = _WORD.findall(unit)
    holes = unit.count(_HOLE)
    if not tokens:
        return LOOSE
    words = list(filter(str.isalpha, tokens))
    cjk = 0 if latin else sum(map(_FIRST_CJK.__le__, words))
    wide = 2 * cjk > len(words)
    count = cjk / PER_WORD if wide else len(words)
    size = sum(map(len, unit.split()))
    if holes >= 0.4 * size:
        return LOOSE
    if LEAST_WORDS <= count <= MOST_WORDS and len(words) >= 0.7 * len(tokens) and _CLOSED.search(unit):
        return CROWDED_CLAUSE if _is_crowded(words, size, wide) else CLAUSE
    return CLAUSE if not wide and count >= RUNNING and _runs(tokens) else LOOSE


def measures(text: str) -> tuple[int, float | None, float | None, float | None, bool | None]:
    """(characters, share of loose ones, share of stuffed ones, share of both that is repeated, whether it is CJK).

    Only characters are told, without white space, where clauses that are not crowded are found to make up so much that
    the page cannot be spam: the rest of it is not read and no automaton is built.
    """
    text = layout(text)
    total = len(text) - sum(map(text.count, _BLANKS))
    parts = []
    clauses = 0
    for begin, end, kind in units(text):
        parts.append((begin, end, kind))
        if kind == CLAUSE:
            clauses += sum(map(len, text[begin:end].split()))
            if clauses > (1 - MOST) * total:
                return total, None, None, None, None
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = np.repeat(np.array([k for _, _, k in parts], np.int8), [b - a for a, b, _ in parts])
    solid = ~np.isin(codes, _BLANK_CODES)
    if not total:
        return 0, None, None, None, None
    wide = ((codes >= ord(_FIRST_CJK)) & (codes < 0xFFDD) & solid).sum() / total
    cjk = bool(wide > 0.3)
    loose, crowded = solid & (kinds == LOOSE), solid & (kinds == CROWDED_CLAUSE)
    least = (LONG_CJK if cjk else LONG, SHORT_CJK if wide > MIXED else SHORT)
    if len(text) > STRETCH:
        long, again = (windows(codes, n) for n in least)
    else:
        longest = repeats(text)
        long, again = (covered(longest, n) for n in least)
    stuffed = np.zeros(len(text), bool)
    for begin, end, kind in parts:
        if kind == CROWDED_CLAUSE and 2 * long[begin:end].sum() >= end - begin:
            stuffed[begin:end] = crowded[begin:end]
    suspect = loose | stuffed
    return total, float(loose.sum() / total), float(stuffed.sum() / total), float((again & suspect).sum() / max(1, suspect.sum())), cjk


def page_measures(pages: DataFrame, page_id: str, text: str) -> DataFrame:
    """(page_id, characters, loose_share, stuffed_share, repeated_share, cjk) of every page; shares are null where clauses make up most of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measures(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*found, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[1:4]), pa.array(columns[4], pa.bool_())],
                names=["page_id", "characters", "loose_share", "stuffed_share", "repeated_share", "cjk"],
            )

    chosen = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(text).alias("text")).where("length(text) > 0")
    return chosen.mapInArrow(run, "page_id long, characters long, loose_share double, stuffed_share double, repeated_share double, cjk boolean")


def spam_pages(pages: DataFrame, page_id: str, text: str, repeated: float = REPEATED, repeated_cjk: float = REPEATED_CJK) -> DataFrame:
    """The measures of the pages that are spam."""
    enough = F.when(F.col("cjk"), repeated_cjk).otherwise(repeated)
    return page_measures(pages, page_id, text).where((F.col("loose_share") + F.col("stuffed_share") >= MOST) & (F.col("repeated_share") >= enough))
