"""Most similar vectors for every vector (problem 5): inverted lists, product-quantised residuals, exact reranking.

Vectors are usable if they have ``DIMENSIONS`` finite values that are not all zero; they are scaled to length 1. Each
embedding space has a model of its own: coarse centroids (about n ** 0.4) and, for the residuals, one codebook of at most
256 entries for each of ``PARTS`` parts. It is trained on a sample of ``SAMPLE`` of its rows, or of ``PER_LIST`` for each
list where that is more, and of at most ``MOST_SAMPLE``. All rows are in the index.

* A row lies in the list of its nearest centroid with an 8-byte code of its residual and the length of the code's error.
* A query visits lists, reads distances from a table of its own (asymmetric: the query is not quantised), and what the
  table cannot rule out is compared exactly.

``pairs_within`` finds all pairs of at least a given similarity, with nothing lost: rows x and y no further apart than d
lie in one list, or one of them is within d/2 of the plane between both centroids and visits the other's list; and a code
rules a pair out only if its distance less its error is above d. ``most_similar`` visits the ``VISITED`` nearest lists,
however many there are, so a query is compared with n ** 0.6 rows, and has a recall below 1 (measured in the tests).

Models travel with the tasks: 256 bytes for each list and codebook entry, 64 KB to 1.1 MB for a space of up to a billion
rows. Where there are more than ``SPACES_AT_ONCE`` spaces, they are searched in blocks of about so many.

Lists that the sample shows to be large are split by a hash of the row number, and what visits them goes to each part, so
a hot list spreads over many tasks; a task holds the members of one part and streams the visitors. Exact copies are
classes: only their first row is compared, and the members are joined to the result.

Rows whose vector is null or not usable, or whose space is null, are left out. A number that comes twice with the same
vector is one member. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.session import as_table

DIMENSIONS = 64
PARTS = 8
SAMPLE, PER_LIST, MOST_SAMPLE = 20_000, 40, 200_000
ROUNDS = 8
PART_ROWS = 8192
SPACES_AT_ONCE = 200
VISITED = 8
RERANK = 200
CELLS = 2_000_000

_POSTINGS = "space string, list int, part int, visitor boolean, record_no long, vector binary, code binary, error float"


# --- training -----------------------------------------------------------------


def _means(points: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from a random start; empty means stay where they were."""
    rng = np.random.default_rng(seed)
    means = points[np.sort(rng.choice(len(points), min(count, len(points)), replace=False))].copy()
    for _ in range(ROUNDS):
        own = np.argmin((means * means).sum(1) - 2 * points @ means.T, axis=1)
        sizes = np.bincount(own, minlength=len(means))
        sums = np.zeros_like(means)
        np.add.at(sums, own, points)
        means[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return means


def lists_of(rows: int) -> int:
    """Lists of a space with so many rows."""
    return 1 << max(0, round(math.log2(max(1, rows) ** 0.4)))


class Model:
    """Centroids, codebooks and the number of parts of each list of one space."""

    def __init__(self, centroids: np.ndarray, books: np.ndarray, parts: np.ndarray) -> None:
        self.centroids, self.books, self.parts = centroids, books, parts
        self.squares = (centroids * centroids).sum(1)

    def apart(self, own: np.ndarray) -> np.ndarray:
        """Distances of some centroids to all."""
        squares = self.squares[own][:, None] + self.squares - 2 * self.centroids[own] @ self.centroids.T
        return np.sqrt(np.maximum(squares, 1e-12))

    @classmethod
    def train(cls, sample: np.ndarray, rows: int, part_rows: int = PART_ROWS) -> Model:
        lists = lists_of(rows)
        centroids = _means(sample, lists, 1)
        own = np.argmin((centroids * centroids).sum(1) - 2 * sample @ centroids.T, axis=1)
        rest = sample - centroids[own]
        width = sample.shape[1] // PARTS
        books = np.stack([_means(np.ascontiguousarray(rest[:, k * width : (k + 1) * width]), 256, 2 + k) for k in range(PARTS)])
        expected = np.bincount(own, minlength=len(centroids)) * (rows / len(sample))
        return cls(centroids, books, np.maximum(1, np.ceil(expected / part_rows)).astype(np.int64))

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distances to the centroids."""
        return np.maximum((vectors * vectors).sum(1)[:, None] + self.squares - 2 * vectors @ self.centroids.T, 0)

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals and the lengths of their errors."""
        width = rest.shape[1] // PARTS
        codes = np.empty((len(rest), PARTS), np.uint8)
        error = np.zeros(len(rest), np.float32)
        for k, book in enumerate(self.books):
            part = rest[:, k * width : (k + 1) * width]
            far = (book * book).sum(1) - 2 * part @ book.T
            codes[:, k] = far.argmin(1)
            error += ((part - book[codes[:, k]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def tables(self, rest: np.ndarray) -> np.ndarray:
        """Per residual and part, squared distances to the entries of the codebook."""
        width = rest.shape[1] // PARTS
        out = np.empty((len(rest), PARTS, self.books.shape[1]), np.float32)
        for k, book in enumerate(self.books):
            part = rest[:, k * width : (k + 1) * width]
            out[:, k] = (part * part).sum(1)[:, None] + (book * book).sum(1) - 2 * part @ book.T
        return np.maximum(out, 0)


def usable(rows: DataFrame, record_no: str, vector: str, space: Column, dimensions: int = DIMENSIONS) -> DataFrame:
    """(record_no, space, vector) of the rows with a usable vector."""
    chosen = rows.select(F.col(record_no).cast("long").alias("record_no"), space.alias("space"), F.col(vector).cast("array<float>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
                yield batch.filter(pa.array(np.isfinite(values).all(1) & values.any(1)))

    return chosen.where((F.size("vector") == dimensions) & F.col("space").isNotNull() & F.col("record_no").isNotNull()).mapInArrow(run, chosen.schema)


def _unit(batch: pa.RecordBatch, column: int) -> np.ndarray:
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
    with np.errstate(over="ignore"):
        values /= np.abs(values).max(1, keepdims=True)  # no square of a large number
    return (values / np.sqrt((values * values).sum(1, keepdims=True))).astype(np.float32)


def space_blocks(vectors: DataFrame, at_once: int = SPACES_AT_ONCE) -> list[DataFrame]:
    """The vectors in blocks of about so many spaces, by a hash of the space."""
    blocks = max(1, -(-vectors.select("space").distinct().count() // at_once))
    return [vectors if blocks == 1 else vectors.where(F.pmod(F.xxhash64("space"), F.lit(blocks)) == k) for k in range(blocks)]


def train(vectors: DataFrame, part_rows: int = PART_ROWS) -> dict[str, Model]:
    """One model per space of a block. The samples are drawn by a hash of the row number and trained in tasks; only models reach the driver."""
    counts = {r[0]: r[1] for r in vectors.groupBy("space").count().collect()}
    if not counts:
        return {}
    sizes = {name: min(MOST_SAMPLE, max(SAMPLE, PER_LIST * lists_of(n))) for name, n in counts.items()}
    # a fifth more than wanted is drawn by chance, then cut to the bound in the task
    share = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, min(1.0, 1.2 * sizes[name] / n))])[F.col("space")]
    drawn = vectors.where(F.pmod(F.xxhash64("record_no"), F.lit(1 << 20)) < share * (1 << 20))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        name = frame["space"].iloc[0]
        frame = frame.sort_values("record_no").head(sizes[name])
        values = np.stack(frame["vector"].to_numpy()).astype(np.float64)
        values /= np.abs(values).max(1, keepdims=True)
        values = (values / np.sqrt((values * values).sum(1, keepdims=True))).astype(np.float32)
        model = Model.train(values, counts[name], part_rows)
        return pd.DataFrame(
            {"space": [name], "centroids": [model.centroids.tobytes()], "books": [model.books.tobytes()], "entries": [model.books.shape[1]], "parts": [model.parts.tobytes()], "width": [values.shape[1]]}
        )

    fitted = drawn.groupBy("space").applyInPandas(fit, "space string, centroids binary, books binary, entries int, parts binary, width int")
    return {
        r.space: Model(
            np.frombuffer(r.centroids, np.float32).reshape(-1, r.width),
            np.frombuffer(r.books, np.float32).reshape(PARTS, r.entries, -1),
            np.frombuffer(r.parts, np.int64),
        )
        for r in fitted.collect()
    }


# --- postings -------------------------------------------------------------------


def _fixed(values: np.ndarray) -> pa.Array:
    """Rows of an array as binary values."""
    data = np.ascontiguousarray(values)
    width = data.shape[1] * data.itemsize
    offsets = np.arange(len(data) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _spread(numbers: np.ndarray, parts: np.ndarray) -> np.ndarray:
    mixed = (numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return (mixed % parts.astype(np.uint64)).astype(np.int64)


def _lists(models: dict[str, Model], visits: Callable, every_part: bool) -> Callable:
    """Members and visitors of the lists. ``visits(model, numbers, far, own)`` gives (row, list) of the visits to lists.

    With ``every_part``, members also visit the later parts of their own list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            which = coded.indices.to_numpy(zero_copy_only=False)
            for at, name in enumerate(coded.dictionary.to_pylist()):
                mine = batch.filter(pa.array(which == at))
                model = models.get(name)
                if model is None or not mine.num_rows:
                    continue
                numbers = mine.column(0).to_numpy()
                vectors = _unit(mine, 2)
                far = model.distances(vectors)
                own = far.argmin(1)
                codes, error = model.encode(vectors - model.centroids[own])
                part = _spread(numbers, model.parts[own])
                row, to = visits(model, numbers, far, own)
                row, to = np.asarray(row, np.int64), np.asarray(to, np.int64)
                times = model.parts[to]
                v_row, v_list = np.repeat(row, times), np.repeat(to, times)
                v_part = np.arange(len(v_row)) - np.repeat(np.cumsum(times) - times, times)
                if every_part:
                    later = model.parts[own] - 1 - part
                    o_row = np.repeat(np.arange(len(own)), later)
                    o_part = np.arange(len(o_row)) - np.repeat(np.cumsum(later) - later, later) + 1 + part[o_row]
                    v_row, v_list, v_part = np.concatenate((v_row, o_row)), np.concatenate((v_list, own[o_row])), np.concatenate((v_part, o_part))
                n, v = len(own), len(v_row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * (n + v), pa.string()),
                        pa.array(np.concatenate((own, v_list)).astype(np.int32)),
                        pa.array(np.concatenate((part, v_part)).astype(np.int32)),
                        pa.array(np.arange(n + v) >= n),
                        pa.array(np.concatenate((numbers, numbers[v_row]))),
                        pa.concat_arrays([_fixed(vectors), _fixed(vectors[v_row])]) if v else _fixed(vectors),
                        pa.concat_arrays([_fixed(codes), pa.array([b""] * v, pa.binary())]),
                        pa.array(np.concatenate((error, np.zeros(v, np.float32)))),
                    ],
                    names=["space", "list", "part", "visitor", "record_no", "vector", "code", "error"],
                )

    return run


def _block(batch: pa.RecordBatch, lo: int, hi: int, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    part = batch.slice(lo, hi - lo)
    join = lambda i: b"".join(part.column(i).to_pylist())
    return (
        part.column(4).to_numpy(),
        np.frombuffer(join(5), np.float32).reshape(hi - lo, -1),
        np.frombuffer(join(6), np.uint8).reshape(-1, PARTS),
        part.column(7).to_numpy(),
    )


def _visit(models: dict[str, Model], compare: Callable, schema: pa.Schema, among: bool) -> Callable:
    """Streams visitors past the members of each part. Rows come sorted by part, members first.

    ``compare(model, list, members, numbers, vectors, own)`` gives the result columns; ``own`` says that the visitors are
    the members themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        gathered: list[tuple] = []
        members: tuple | None = None

        def close() -> Iterator[pa.RecordBatch]:
            """All members of a part are here: join them, and compare them with each other."""
            nonlocal members, gathered
            if gathered:
                members = tuple(np.concatenate(c) for c in zip(*gathered, strict=True))
                gathered = []
                if among:
                    yield from against(members[0], members[1], True)

        def against(numbers: np.ndarray, vectors: np.ndarray, own: bool) -> Iterator[pa.RecordBatch]:
            step = max(1, CELLS // max(1, len(members[0])))
            for lo in range(0, len(numbers), step):
                columns = compare(models[key[0]], key[1], members, numbers[lo : lo + step], vectors[lo : lo + step], lo if own else None)
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        for batch in batches:
            spaces, lists, parts = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            visitor = batch.column(3).to_numpy(zero_copy_only=False)
            coded = spaces.dictionary_encode()
            names, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            change = (np.diff(lists) != 0) | (np.diff(parts) != 0) | (np.diff(which) != 0) | (np.diff(visitor.astype(np.int8)) != 0)
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                here = (names[which[lo]], int(lists[lo]), int(parts[lo]))
                if here != key:
                    yield from close()
                    key, members = here, None
                numbers, vectors, codes, error = _block(batch, lo, hi, models[here[0]])
                if not visitor[lo]:
                    gathered.append((numbers, vectors, codes, error))
                else:
                    yield from close()
                    if members is not None:
                        yield from against(numbers, vectors, False)
        yield from close()

    return run


def _table_distances(model: Model, at: int, codes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Squared distances of vectors to the coded members of a list, summed from the vectors' own tables."""
    tables = model.tables(vectors - model.centroids[at])
    total = np.take(tables[:, 0], codes[:, 0], axis=1)
    for k in range(1, PARTS):
        total += np.take(tables[:, k], codes[:, k], axis=1)
    return total


def _placed(vectors: DataFrame, models: dict[str, Model], visits: Callable, every_part: bool) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(models)  # of one block of spaces, each of a size that grows with n ** 0.4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _lists(shared.value, visits, every_part)(batches)

    return (
        vectors.mapInArrow(run, _POSTINGS)
        .repartition("space", "list", "part")
        .sortWithinPartitions("space", "list", "part", "visitor")
    )


# --- searches -------------------------------------------------------------------


def classes(vectors: DataFrame) -> DataFrame:
    """(first_no, record_no): every row with the first row of the same space and exactly the same vector, as a written table."""
    marked = vectors.select("record_no", "space", F.xxhash64("space", "vector").alias("h"), F.hash("vector", "space").alias("g"))
    first = marked.groupBy("space", "h", "g").agg(F.min("record_no").alias("first_no"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    return as_table(marked.join(first, ["space", "h", "g"]).select("first_no", "record_no").distinct(), "classes")


def class_members(vectors: DataFrame) -> DataFrame:
    """(record_no, class_no, copies): every usable row with the first row of its class of exact copies and the size of the class."""
    copies = classes(vectors)
    sizes = copies.groupBy("first_no").agg(F.count("*").alias("copies"))
    known = copies.join(sizes, "first_no").select("record_no", F.col("first_no").alias("class_no"), "copies")
    return vectors.select("record_no").distinct().join(known, "record_no", "left").select("record_no", F.coalesce("class_no", "record_no").alias("class_no"), F.coalesce("copies", F.lit(1)).alias("copies"))


def representative_pairs(vectors: DataFrame, least: float, copies: DataFrame, part_rows: int = PART_ROWS, at_once: int = SPACES_AT_ONCE) -> DataFrame:
    """(first_no, second_no, similarity) of the first rows of all classes that are at least ``least`` alike."""
    later = copies.where("record_no <> first_no").select("record_no").distinct()
    first = vectors.join(later, "record_no", "left_anti").select("record_no", "space", "vector")
    return reduce(DataFrame.unionByName, [_pairs_of_block(block, least, part_rows) for block in space_blocks(first, at_once)])


def _pairs_of_block(vectors: DataFrame, least: float, part_rows: int) -> DataFrame:
    models = train(vectors, part_rows)
    reach = math.sqrt(2 - 2 * least)

    def visits(model: Model, numbers: np.ndarray, far: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, lists = [], []
        step = max(1, CELLS // far.shape[1])
        for lo in range(0, len(own), step):
            part = slice(lo, lo + step)
            mine, at = own[part], np.arange(len(own[part]))
            to_plane = (far[part] - far[part][at, mine][:, None]) / (2 * model.apart(mine))
            to_plane[at, mine] = np.inf
            row, to = np.nonzero(to_plane <= reach / 2 + 1e-4)
            rows.append(row + lo)
            lists.append(to)
        return np.concatenate(rows), np.concatenate(lists)

    def compare(model: Model, at: int, members: tuple, numbers: np.ndarray, queries: np.ndarray, own: int | None) -> list[np.ndarray]:
        m_numbers, m_vectors, m_codes, m_error = members
        left = np.sqrt(_table_distances(model, at, m_codes, queries)) - m_error <= reach + 1e-3
        if own is not None:  # each pair of members once
            left &= np.arange(len(m_numbers)) > (np.arange(len(numbers)) + own)[:, None]
        q, m = np.nonzero(left)
        similarity = np.empty(len(q))
        for lo in range(0, len(q), 100_000):
            part = slice(lo, lo + 100_000)
            similarity[part] = np.einsum("ij,ij->i", queries[q[part]].astype(np.float64), m_vectors[m[part]].astype(np.float64))
        kept = (similarity >= least) & (numbers[q] != m_numbers[m])
        a, b = numbers[q[kept]], m_numbers[m[kept]]
        return [np.minimum(a, b), np.maximum(a, b), similarity[kept]]

    placed = _placed(vectors, models, visits, True)
    shared = vectors.sparkSession.sparkContext.broadcast(models)
    schema = pa.schema([("first_no", pa.int64()), ("second_no", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _visit(shared.value, compare, schema, True)(batches)

    # a pair may meet in both of its lists
    return placed.mapInArrow(run, "first_no long, second_no long, similarity double").groupBy("first_no", "second_no").agg(F.max("similarity").alias("similarity"))


def pairs_within(vectors: DataFrame, least: float, part_rows: int = PART_ROWS) -> DataFrame:
    """(first_no, second_no): all pairs of rows of one space that are at least ``least`` alike, copies included."""
    copies = classes(vectors)
    between = as_table(representative_pairs(vectors, least, copies, part_rows), "between").select("first_no", "second_no")
    # every first row stands for itself; classes of one row need no entry in the table of copies
    of = lambda side, name: copies.select(F.col("first_no").alias(side), F.col("record_no").alias(name))
    wide = (
        between.join(of("first_no", "a"), "first_no", "left")
        .join(of("second_no", "b"), "second_no", "left")
        .select(F.coalesce("a", "first_no").alias("a"), F.coalesce("b", "second_no").alias("b"))
    )
    inside = of("first_no", "a").join(of("first_no", "b"), "first_no").where("a < b").select("a", "b")
    return wide.unionByName(inside).select(F.least("a", "b").alias("first_no"), F.greatest("a", "b").alias("second_no"))


def most_similar(vectors: DataFrame, is_query: Callable[[np.ndarray], np.ndarray], k: int = 10, visited: int = VISITED, part_rows: int = PART_ROWS, at_once: int = SPACES_AT_ONCE) -> DataFrame:
    """(record_no, rank, neighbour_no, similarity): the ``k`` most similar rows of the same space for each query row."""
    return reduce(DataFrame.unionByName, [_nearest_of_block(block, is_query, k, visited, part_rows) for block in space_blocks(vectors, at_once)])


def _nearest_of_block(vectors: DataFrame, is_query: Callable[[np.ndarray], np.ndarray], k: int, visited: int, part_rows: int) -> DataFrame:
    models = train(vectors, part_rows)

    def visits(model: Model, numbers: np.ndarray, far: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.flatnonzero(is_query(numbers))
        lists = min(far.shape[1], visited)
        near = np.argpartition(far[rows], lists - 1, axis=1)[:, :lists] if len(rows) else np.empty((0, lists), np.int64)
        return np.repeat(rows, lists), near.ravel()

    def compare(model: Model, at: int, members: tuple, numbers: np.ndarray, queries: np.ndarray, own: int | None) -> list[np.ndarray]:
        m_numbers, m_vectors, m_codes, _ = members
        guess = _table_distances(model, at, m_codes, queries)
        keep = min(RERANK, len(m_numbers))
        best = np.argpartition(guess, keep - 1, axis=1)[:, :keep]
        similarity = np.einsum("ij,ikj->ik", queries.astype(np.float64), m_vectors[best].astype(np.float64))
        similarity[m_numbers[best] == numbers[:, None]] = -np.inf
        top = np.argsort(-similarity, axis=1, kind="stable")[:, :k]
        a = np.repeat(numbers, top.shape[1])
        b = np.take_along_axis(m_numbers[best], top, 1).ravel()
        s = np.take_along_axis(similarity, top, 1).ravel()
        fine = np.isfinite(s)
        return [a[fine], b[fine], s[fine]]

    placed = _placed(vectors, models, visits, False)
    shared = vectors.sparkSession.sparkContext.broadcast(models)
    schema = pa.schema([("record_no", pa.int64()), ("neighbour_no", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _visit(shared.value, compare, schema, False)(batches)

    best = W.partitionBy("record_no").orderBy(F.desc("similarity"), "neighbour_no")
    return (
        placed.mapInArrow(run, "record_no long, neighbour_no long, similarity double")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("record_no", "rank", "neighbour_no", "similarity")
    )
