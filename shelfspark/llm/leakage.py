"""Evaluation texts leaking into training text (problem 6): a distributed positional inverted index.

Terms are runs of three words, or of five characters in scripts without spaces, of the plain text (entities and tags
resolved, compatibility forms and letter case folded, punctuation and layout dropped).

1. ``build_index`` reads every training document once and whole and stores the postings of all its terms, whatever the
   test items are: tasks invert what they read into shards, and a shard is a list of (term, document, place) sorted by
   term, in blocks with their first and last term. Nothing is shuffled. The table is written once and serves any number
   of test sets.
2. Test items lose the opening line that they share with others: the longest beginning that ``SHARED_LEAD`` items have.
3. The lists of the test terms are taken out of the blocks by a merge of both sorted lists, and the document frequency of
   each term is counted over all documents. The rarest ``RAREST`` share of an item's terms are looked at first: a document
   with the wanted share of all terms must hold one to three of them, by the item's length, so nothing that can reach the
   threshold is lost here.
4. What is left is verified with all terms of the item. Their postings, each shifted back by the term's place in the
   item, must meet in bands of offsets, one to three terms in each, by the item's length. The share of the item's terms
   that stand in these bands decides, which is the proximity match: an item held in several places counts by all of
   them, terms that stand alone do not count. The share of its words they cover and the longest covered stretch in one
   place, the exact phrase, are reported.

The test items travel with the tasks in blocks of at most ``BLOCK_CHARS`` characters, each of which searches the same
index; an item is never cut, so the blocks change nothing. Null and blank documents and items hold nothing. Items
shorter than one term are never found. A number that stands twice among the documents counts as one document, whose
pairs come once. Empty tables give an empty result.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.session import as_table, fresh_path

WORDS, CHARACTERS = 3, 5
SHARED_LEAD = 5
RAREST = 0.7
#: Offsets are compared in bands this wide, in words; two grids half a band apart.
BAND = 64
LEAST_RARE = 3
LEAST_SHARE = 0.4
#: Characters of test items that travel with one search.
BLOCK_CHARS = 4_000_000
#: Postings of a shard and of one of its blocks.
SHARD_POSTINGS, BLOCK_POSTINGS = 1_000_000, 16_384
#: Blocks of a row group of the index. Readers decode a row group at once, so this bounds their memory: 16 times 16,384 postings of 20 bytes.
GROUP_BLOCKS = 16
#: Bytes of a row group of the postings of test terms, whose rows are documents of any length.
GROUP_BYTES = 8 << 20
#: Words that a task turns into postings at a time, or one document.
WORDS_AT_ONCE = 200_000
#: Words whose hashes a task keeps.
KNOWN_WORDS = 500_000
#: Places of items that a task looks at together.
MOST_PLACES = 2_000_000

_CJK = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_TOKEN = re.compile(f"[{_CJK}]|[^\\W_{_CJK}]+")
_TAG = re.compile(r"<[^<>]*>")
_UNSEEN = re.compile("[\u200b\u200c\u200d\ufeff\u00ad]")
#: Time marks and the counters of subtitles are layout.
_MARKS = re.compile(r"[\[(]?\b\d{1,2}(?::\d\d){1,2}(?:[.,]\d{1,3})?\b[\])]?|^\s*\d+\s*$", re.M)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Words and single characters of the plain text."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _UNSEEN.sub("", text))
    if ":" in text:
        text = _MARKS.sub(" ", text)
    return _TOKEN.findall(text.lower())


def _hash(word: str) -> int:
    """64 bits that are never 0; the last one tells scripts without spaces."""
    return xxhash.xxh64_intdigest(word) & ~1 | 2 | ("\u3040" <= word[0] <= "\uffdc")


def hashes_of(words: list[str], known: dict[str, int]) -> list[int]:
    """Hashes of words; ``known`` keeps them for the next call."""
    try:
        return [known[w] for w in words]
    except KeyError:
        for word in set(words).difference(known):
            known[word] = _hash(word)
        return [known[w] for w in words]


def terms_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term and its length at each position; length 0 where no term begins. No term reaches over a hash of 0."""
    n = len(hashes)
    wide = (hashes & np.uint64(1)).astype(bool)
    terms, lengths = np.zeros(n, np.uint64), np.zeros(n, np.int32)
    if not n:
        return terms, lengths
    known = hashes != 0
    for length, of in ((WORDS, ~wide), (CHARACTERS, wide)):
        if n < length:
            continue
        m = n - length + 1
        value, whole = np.full(m, length, np.uint64), of[:m].copy()
        for k in range(length):
            value = value * _STEP + hashes[k : k + m]
            value ^= value >> np.uint64(29)
            whole &= known[k : k + m]
        terms[:m][whole], lengths[:m][whole] = value[whole], length
    return terms, lengths


class TestTerms:
    """Terms of the test items: sorted, each with the places in items where it stands."""

    def __init__(self, items: dict[int, list[str]]) -> None:
        """``items`` has the words of each item without its shared beginning."""
        known: dict[str, int] = {}
        parts: list[tuple[np.ndarray, ...]] = []
        self.items = np.array(sorted(items), np.int64)
        self.item_words, self.item_terms = np.zeros(len(self.items), np.int64), np.zeros(len(self.items), np.int64)
        for number, item in enumerate(self.items.tolist()):
            own = items[item]
            terms, lengths = terms_of(np.array(hashes_of(own, known), np.uint64))
            at = np.flatnonzero(lengths)
            self.item_words[number], self.item_terms[number] = len(own), len(at)
            parts.append((terms[at].view(np.int64), np.full(len(at), number), at, lengths[at].astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 4
        order = np.argsort(columns[0], kind="stable")
        term, self.of_item, self.item_at, self.length = (c[order] for c in columns)
        self.terms, self.first, self.places = np.unique(term, return_index=True, return_counts=True)
        self.rare = np.ones(len(term), bool)

    def keep_rarest(self, documents: dict[int, int]) -> None:
        """Marks, per item, the places of its rarest terms; ``documents`` has how many documents hold each term."""
        frequency = np.repeat(np.array([documents.get(t, 0) for t in self.terms.tolist()], np.int64), self.places)
        order = np.lexsort((self.item_at, frequency, self.of_item))
        starts = np.concatenate(([0], np.cumsum(self.item_terms)))[:-1]
        rank = np.arange(len(order)) - starts[self.of_item[order]]
        self.rare = np.zeros(len(order), bool)
        self.rare[order] = rank < np.ceil(RAREST * self.item_terms[self.of_item[order]])

    def least_rare(self, least_share: float) -> np.ndarray:
        """Rare terms of each item that are asked for: a document with ``least_share`` of all its terms has no fewer. At most ``LEAST_RARE``."""
        rare = np.ceil(RAREST * self.item_terms)
        return np.clip(np.ceil(least_share * self.item_terms - 1e-9) - (self.item_terms - rare), 1, LEAST_RARE)


INDEX = "low long, high long, terms array<long>, documents array<long>, places array<int>"
#: A dictionary would make the terms of a small row group larger, as most of them stand there once.
INDEX_OPTIONS = {"compression": "zstd", "parquet.block.row.count.limit": GROUP_BLOCKS, "parquet.enable.dictionary#terms.list.element": "false"}


def _shard(terms: np.ndarray, documents: np.ndarray, places: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """The sorted blocks of a shard, in batches of a few MB."""
    order = np.argsort(terms, kind="stable")
    terms, documents, places = terms[order], documents[order], places[order]
    for lo in range(0, len(terms), GROUP_BLOCKS * block):
        part = slice(lo, lo + GROUP_BLOCKS * block)
        own = terms[part]
        edges = np.append(np.arange(0, len(own), block), len(own)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(c)) for c in (own, documents[part], places[part])]
        yield pa.RecordBatch.from_arrays([pa.array(own[edges[:-1]]), pa.array(own[edges[1:] - 1]), *lists], names=["low", "high", "terms", "documents", "places"])


def _post(ids: list[int], counts: list[int], hashes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, place) of all terms of some documents, whose words are each followed by a 0."""
    terms, lengths = terms_of(np.array(hashes, np.uint64))
    at = np.flatnonzero(lengths)
    of = np.repeat(np.arange(len(ids)), counts)[at]
    return terms[at].view(np.int64), np.array(ids, np.int64)[of], (at - np.cumsum([0, *counts])[of]).astype(np.int32)


def _invert(shard: int, block: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        ids, counts, hashes = [], [], []
        for batch in batches:
            for row in range(batch.num_rows):
                found = hashes_of(words_of(batch.column(1)[row].as_py()), known)
                hashes += found
                hashes.append(0)  # no term reaches into the next document
                ids.append(batch.column(0)[row].as_py())
                counts.append(len(found) + 1)
                if len(hashes) < WORDS_AT_ONCE:
                    continue
                held.append(_post(ids, counts, hashes))
                size += len(held[-1][0])
                ids, counts, hashes = [], [], []
                if len(known) > KNOWN_WORDS:
                    known = {}
                if size >= shard:
                    yield from _shard(*(np.concatenate(c) for c in zip(*held, strict=True)), block)
                    held, size = [], 0
        held.append(_post(ids, counts, hashes))
        if size + len(held[-1][0]):
            yield from _shard(*(np.concatenate(c) for c in zip(*held, strict=True)), block)

    return run


def build_index(documents: DataFrame, doc_id: str, text: str, shard_postings: int = SHARD_POSTINGS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """The positional postings of all terms of all documents, as a written table of sorted blocks."""
    whole = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and length(text) > 0")
    path = fresh_path(documents.sparkSession, "postings")
    whole.mapInArrow(_invert(shard_postings, block_postings), INDEX).write.options(**INDEX_OPTIONS).parquet(path)
    return documents.sparkSession.read.schema(INDEX).parquet(path)


def _merge_lists(wanted: np.ndarray) -> Callable:
    """Postings of the wanted terms, which are sorted, out of sorted blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column(2).flatten().to_numpy()
            slot = np.searchsorted(wanted, terms)
            hit = np.flatnonzero(wanted[np.minimum(slot, len(wanted) - 1)] == terms) if len(wanted) else np.empty(0, np.int64)
            columns = [pa.array(terms[hit])] + [pa.array(batch.column(k).flatten().to_numpy()[hit]) for k in (3, 4)]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "doc_id", "place"])

    return run


def postings(index: DataFrame, tests: TestTerms) -> DataFrame:
    """(doc_id, terms, places): the postings of the test terms, one row per document, as a written table."""
    shared = index.sparkSession.sparkContext.broadcast(tests.terms)  # of one block of test items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _merge_lists(shared.value)(batches)

    inside = index.where((F.col("high") >= int(tests.terms[0])) & (F.col("low") <= int(tests.terms[-1]))) if len(tests.terms) else index.limit(0)
    hits = inside.mapInArrow(run, "term long, doc_id long, place int")
    # a document that comes twice has its postings twice, and is one document
    lists = hits.groupBy("doc_id").agg(F.collect_set(F.struct("term", "place")).alias("hits"))
    return as_table(lists.select("doc_id", F.col("hits.term").alias("terms"), F.col("hits.place").alias("places")), "test-postings", **{"parquet.block.size": GROUP_BYTES})


def document_frequency(lists: DataFrame) -> DataFrame:
    """(term, documents) over all documents; tasks count before anything is shuffled."""
    return lists.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("documents"))


def _covered(tests: TestTerms, entry: np.ndarray) -> np.ndarray:
    """Numbers of the words of an item that some of its terms cover."""
    return np.unique(np.concatenate([np.arange(a, a + n) for a, n in zip(tests.item_at[entry], tests.length[entry], strict=True)]))


def _longest(words: np.ndarray) -> int:
    """Longest run of consecutive numbers in a sorted array."""
    breaks = np.flatnonzero(np.diff(words) != 1)
    return int(np.diff(np.concatenate(([-1], breaks, [len(words) - 1]))).max())


def _meet(tests: TestTerms, docs: np.ndarray, terms: np.ndarray, places: np.ndarray, least_share: float) -> Iterator[tuple]:
    """Matches among the postings of some documents (``docs`` numbers them from 0): (item, doc, term share, word share, longest phrase)."""
    slot = np.searchsorted(tests.terms, terms)
    times = tests.places[slot]
    row = np.repeat(np.arange(len(terms)), times)
    entry = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + tests.first[slot][row]
    pair = docs[row] * len(tests.items) + tests.of_item[entry]
    offset = places[row] - tests.item_at[entry]
    # pairs that can reach the share: with as many terms, and as many rare ones among them
    least = tests.least_rare(least_share)
    known, first, times = np.unique(pair, return_inverse=True, return_counts=True)
    own = known % len(tests.items)
    enough = (times >= least_share * tests.item_terms[own] - 1e-9) & (np.bincount(first, tests.rare[entry], len(known)) >= least[own])
    chosen = enough[first]
    pair, entry, offset = pair[chosen], entry[chosen], offset[chosen]
    if not len(pair):
        return
    base = int(offset.min())
    span = int(offset.max() - base) // BAND + 3
    cells = np.concatenate([((pair * span + (offset - base + grid * BAND // 2) // BAND) * 2 + grid) for grid in (0, 1)])
    cell, hits = np.unique(cells, return_counts=True)
    cell = cell[hits >= least[cell // (2 * span) % len(tests.items)]]
    if not len(cell):
        return
    # all bands of a pair, with half a band on either side, as half bands that count
    of_pair, first_half = cell // (2 * span), cell // 2 % span * 2 - cell % 2
    halves = 2 * span + 4
    marked = np.unique(np.concatenate([of_pair * halves + first_half + k for k in (1, 2, 3, 4)]))
    stretch = np.cumsum(np.concatenate(([True], np.diff(marked) != 1)))
    found = np.unique(of_pair)
    half = pair * halves + (offset - base) // (BAND // 2) + 2
    slot = np.minimum(np.searchsorted(marked, half), len(marked) - 1)
    near = marked[slot] == half
    entry, stretch, where = entry[near], stretch[slot[near]], np.searchsorted(found, pair[near])
    order = np.lexsort((stretch, where))
    by_pair, by_stretch, starts = entry[order], stretch[order], np.searchsorted(where[order], np.arange(len(found) + 1))
    # each place of an item once
    order = np.lexsort((tests.item_at[entry], where))
    where, entry = where[order], entry[order]
    once = np.concatenate(([True], (np.diff(where) != 0) | (np.diff(tests.item_at[entry]) != 0)))
    where, entry = where[once], entry[once]
    counts = np.bincount(where, minlength=len(found))
    ends = np.cumsum(counts)
    share = counts / tests.item_terms[found % len(tests.items)]
    for k in np.flatnonzero(share >= least_share):
        own = entry[ends[k] - counts[k] : ends[k]]
        words = _covered(tests, own)
        near_by, parts = by_pair[starts[k] : starts[k + 1]], by_stretch[starts[k] : starts[k + 1]]
        longest = max(_longest(_covered(tests, near_by[parts == part])) for part in np.unique(parts))
        number = int(found[k] % len(tests.items))
        yield int(tests.items[number]), int(found[k] // len(tests.items)), float(share[k]), len(words) / int(tests.item_words[number]), longest


def _match(tests: TestTerms, least_share: float, most_places: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            ends = batch.column(1).offsets.to_numpy()
            terms, places = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            ends = ends - ends[0]
            docs = np.repeat(np.arange(len(ids)), np.diff(ends))
            # as many documents at a time as meet a bounded number of places
            weight = np.concatenate(([0], np.cumsum(tests.places[np.searchsorted(tests.terms, terms)])))[ends]
            out: list[tuple] = []
            lo = 0
            while lo < len(ids):
                hi = max(lo + 1, int(np.searchsorted(weight, weight[lo] + most_places, "right")) - 1)
                part = slice(ends[lo], ends[hi])
                out += _meet(tests, docs[part], terms[part], places[part], least_share)
                lo = hi
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()),
                    pa.array(ids[np.array(columns[1], np.int64)], pa.int64()),
                    pa.array(columns[2], pa.float64()),
                    pa.array(columns[3], pa.float64()),
                    pa.array(columns[4], pa.int32()),
                ],
                names=["item_id", "doc_id", "term_share", "covered_share", "longest_phrase"],
            )

    return run


_FOUND = "item_id long, doc_id long, term_share double, covered_share double, longest_phrase int"


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of items and the hashes of all their beginnings."""
    for batch in batches:
        words = [words_of(t) for t in batch.column(1).to_pylist()]
        begins = []
        for own in words:
            begin, every = 0, []
            for word in own:
                begin = xxhash.xxh64_intdigest(word, begin)
                every.append(begin - (1 << 63))
            begins.append(every)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string())), pa.array(begins, pa.list_(pa.int64()))], names=["item_id", "words", "begins"])


def worded_items(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(item_id, words, lead): the words of each item, and how many of them are a beginning that ``SHARED_LEAD`` items have.

    The longest such beginning counts that is not the whole item. Items that come twice are one.
    """
    chosen = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and length(text) > 0")
    plain = as_table(chosen.mapInArrow(_worded, "item_id long, words array<string>, begins array<long>").dropDuplicates(["item_id"]), "items")
    begins = plain.select("item_id", F.size("words").alias("size"), F.posexplode("begins").alias("at", "begin"))
    shared = begins.groupBy("at", "begin").agg(F.count("*").alias("items")).where(F.col("items") >= SHARED_LEAD)
    leads = begins.where("at + 1 < size").join(shared, ["at", "begin"], "left_semi").groupBy("item_id").agg(F.max(F.col("at") + 1).alias("lead"))
    return plain.join(leads, "item_id", "left").select("item_id", "words", F.coalesce("lead", F.lit(0)).alias("lead"))


def item_blocks(worded: DataFrame, block_chars: int) -> Iterator[dict[int, list[str]]]:
    """The items' own words in blocks of at most so many characters, or of one item."""
    block: dict[int, list[str]] = {}
    size = 0
    for row in worded.orderBy("item_id").toLocalIterator():
        own = row["words"][row["lead"] :]
        width = sum(map(len, own))
        if block and size + width > block_chars:
            yield block
            block, size = {}, 0
        block[row["item_id"]] = own
        size += width
    if block:
        yield block


def leaks(index: DataFrame, items: DataFrame, item_id: str, item_text: str, least_share: float = LEAST_SHARE, most_places: int = MOST_PLACES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, doc_id, term_share, covered_share, longest_phrase) of the documents that hold the items; ``index`` comes from :func:`build_index`."""
    context = index.sparkSession.sparkContext
    found = index.sparkSession.createDataFrame([], _FOUND)
    for block in item_blocks(worded_items(items, item_id, item_text), block_chars):
        tests = TestTerms(block)
        lists = postings(index, tests)
        tests.keep_rarest({r[0]: r[1] for r in document_frequency(lists).collect()})  # at most one row per term of the block
        shared = context.broadcast(tests)

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            return _match(shared.value, least_share, most_places)(batches)

        found = found.unionByName(lists.mapInArrow(run, _FOUND))
    return found
