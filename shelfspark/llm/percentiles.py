"""Percentiles of very large numeric columns (problem 4): randomised compactor hierarchies.

A sketch holds levels of values; a value on level ``h`` stands for ``2**h`` values. A level that is too full is sorted
and every other value moves up, beginning at the first or the second by a coin. Sketches merge level by level, so tasks,
partitions and days combine in any order.

Error: compacting level ``h`` moves the rank of any number by at most ``2**h``, either way with equal chance. With V the
sum of ``4**h`` over all compactions of a sketch and of those merged into it, the rank of an answer is off by more than
``sqrt(2 * V * ln(2 / delta))`` with probability ``delta`` at most (Hoeffding). ``rank_error`` reports that bound
divided by the count, at ``DELTA``. Groups that never filled a level are exact.

Coins come from a hash of a label, group, task and number of compactions. Every call draws a label of its own, which
travels with its tasks: a task that is run again gives the same sketch, while tables, days and merges that are built one
after the other draw coins that have nothing to do with each other, as the bound asks.

Tasks hold one sketch per group and pass them on when there are ``FLUSH_VALUES`` values or ``FLUSH_SKETCHES`` sketches;
what is shuffled is sketches, so a hot group costs one small sketch per task. Groups are the combinations of keys that
occur, however many values each key has. Null values are left out, and so is whatever the caller filters. A null group is
a group of its own. Empty input gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 400
DELTA = 0.01
SHRINK = 2 / 3
LEAST_LEVEL = 8
FLUSH_VALUES = 2_000_000
FLUSH_SKETCHES = 50_000


class Compactors:
    """One sketch."""

    __slots__ = ("compactions", "count", "high", "levels", "low", "seed", "size", "variance")

    def __init__(self, size: int = SIZE, seed: int = 0) -> None:
        self.size, self.seed = size, seed
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.count, self.compactions, self.variance = 0, 0, 0.0
        self.low, self.high = math.inf, -math.inf

    @classmethod
    def restore(cls, count: int, variance: float, low: float, high: float, levels: list[list[float]], size: int, seed: int) -> Compactors:
        sketch = cls(size, seed)
        sketch.levels = [np.asarray(level, float) for level in levels] or [np.empty(0)]
        sketch.count, sketch.variance, sketch.low, sketch.high = count, variance, low, high
        return sketch

    def _room(self, level: int) -> int:
        return max(LEAST_LEVEL, math.ceil(self.size * SHRINK ** (len(self.levels) - 1 - level)))

    def _coin(self) -> int:
        self.compactions += 1
        x = (self.seed * 0x9E3779B97F4A7C15 + self.compactions * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        x = (x ^ (x >> 30)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
        return (x >> 40) & 1

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            values = self.levels[level]
            if len(values) > self._room(level):
                values = np.sort(values)
                rest = values[len(values) & ~1 :]  # an odd one stays
                values = values[: len(values) & ~1]
                if level + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                self.levels[level] = rest
                self.levels[level + 1] = np.concatenate((self.levels[level + 1], values[self._coin() :: 2]))
                self.variance += 4.0**level
            level += 1

    def add(self, values: np.ndarray) -> None:
        if len(values):
            self.levels[0] = np.concatenate((self.levels[0], values))
            self.count += len(values)
            self.low, self.high = min(self.low, float(values.min())), max(self.high, float(values.max()))
            self._compact()

    def merge(self, other: Compactors) -> None:
        while len(self.levels) < len(other.levels):
            self.levels.append(np.empty(0))
        for level, values in enumerate(other.levels):
            self.levels[level] = np.concatenate((self.levels[level], values))
        self.count += other.count
        self.variance += other.variance
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        self._compact()

    def held(self) -> int:
        return sum(map(len, self.levels))

    def quantiles(self, shares: list[float]) -> list[float | None]:
        """Smallest held value whose rank is at least share times count."""
        if not self.count:
            return [None] * len(shares)
        values = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(v), 1 << h, np.int64) for h, v in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[order])
        at = np.searchsorted(ranks, [max(1, math.ceil(s * ranks[-1])) for s in shares])
        return [float(min(max(values[order[i]], self.low), self.high)) for i in np.minimum(at, len(values) - 1)]

    def rank_error(self, delta: float = DELTA) -> float:
        """Bound of the rank error as a share of the count, kept with probability 1 - delta."""
        return math.sqrt(2 * self.variance * math.log(2 / delta)) / self.count if self.count else 0.0


_BODY = "count long, variance double, low double, high double, levels array<array<double>>"
_DOUBLES = pa.list_(pa.list_(pa.float64()))


def _seed(label: str, key: tuple, *place: int) -> int:
    return int.from_bytes(hashlib.blake2b(repr((label, key, place)).encode(), digest_size=8).digest())


def _combinations(columns: list[pa.Array], rows: int) -> tuple[np.ndarray, list[tuple]]:
    """Number of its key for each row, and the keys that occur in the batch."""
    codes, keys = np.zeros(rows, np.int64), [()]
    for column in columns:
        coded = column.dictionary_encode(null_encoding="encode")
        values = coded.dictionary.to_pylist()
        # numbered anew after each column, so that numbers stay below the count of rows squared
        seen, codes = np.unique(codes * len(values) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        keys = [(*keys[n // len(values)], values[n % len(values)]) for n in seen.tolist()]
    return codes, keys


def _sketch_batch(sketches: dict[tuple, Compactors], keys: list[str]) -> pa.RecordBatch:
    rows = list(sketches.values())
    arrays = [pa.array([k[i] for k in sketches], pa.string()) for i in range(len(keys))]
    arrays += [
        pa.array([s.count for s in rows], pa.int64()),
        pa.array([s.variance for s in rows], pa.float64()),
        pa.array([s.low for s in rows], pa.float64()),
        pa.array([s.high for s in rows], pa.float64()),
        pa.array([s.levels for s in rows], _DOUBLES),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=[*keys, "count", "variance", "low", "high", "levels"])


def _build(keys: list[str], size: int, label: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        sketches: dict[tuple, Compactors] = {}
        held = flushed = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, names = _combinations(batch.columns[:-1], batch.num_rows)
            values = batch.columns[-1].to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            codes, values = codes[order], values[order]
            edges = (np.flatnonzero(np.diff(codes)) + 1).tolist()
            for lo, hi in zip([0, *edges], [*edges, len(codes)], strict=True):
                key = names[codes[lo]]
                if (sketch := sketches.get(key)) is None:
                    sketch = sketches[key] = Compactors(size, _seed(label, key, task, flushed))
                held -= sketch.held()
                sketch.add(values[lo:hi])
                held += sketch.held()
                if held > FLUSH_VALUES or len(sketches) > FLUSH_SKETCHES:
                    yield _sketch_batch(sketches, keys)
                    sketches, held, flushed = {}, 0, flushed + 1
        if sketches:
            yield _sketch_batch(sketches, keys)

    return run


def _merge(keys: list[str], size: int, label: str) -> Callable:
    """Sketches come sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple, Compactors] = {}
        key, current, held = None, None, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, body = row[: len(keys)], row[len(keys) :]
                if current is None or own != key:
                    if current is not None:
                        done[key] = current
                        held += current.held()
                    if held > FLUSH_VALUES or len(done) > FLUSH_SKETCHES:
                        yield _sketch_batch(done, keys)
                        done, held = {}, 0
                    key, current = own, Compactors.restore(*body, size, _seed(label, own))
                else:
                    current.merge(Compactors.restore(*body, size, 0))
        if current is not None:
            done[key] = current
            yield _sketch_batch(done, keys)

    return run


def _key_schema(keys: list[str]) -> str:
    return ", ".join(f"`{k}` string" for k in keys) + ", " + _BODY


def sketches(rows: DataFrame, keys: dict[str, Column], value: Column, size: int = SIZE, label: str | None = None) -> DataFrame:
    """One sketch per group: the key columns (strings), count, variance, low, high, levels.

    With the same ``label`` the same tasks draw the same coins; by default every call draws its own.
    """
    label = label or uuid.uuid4().hex
    chosen = rows.select(*[c.cast("string").alias(k) for k, c in keys.items()], value.cast("double").alias("value")).where("value is not null and not isnan(value)")
    return merged(chosen.mapInArrow(_build(list(keys), size, label), _key_schema(list(keys))), list(keys), size, f"{label} merged")


def merged(parts: DataFrame, keys: list[str], size: int = SIZE, label: str | None = None) -> DataFrame:
    """Sketches of the same group, from any partitions or days, as one sketch."""
    body = ["count", "variance", "low", "high", "levels"]
    return parts.select(*keys, *body).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merge(keys, size, label or uuid.uuid4().hex), _key_schema(keys))


def percentiles(parts: DataFrame, keys: list[str], shares: dict[str, float], size: int = SIZE) -> DataFrame:
    """The key columns, count, one column per share and rank_error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [Compactors.restore(*body, size, 0) for body in zip(*(c.to_pylist() for c in batch.columns[len(keys) :]), strict=True)]
            answers = [s.quantiles(list(shares.values())) for s in rows]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keys)], pa.array([s.count for s in rows], pa.int64())]
                + [pa.array([a[i] for a in answers], pa.float64()) for i in range(len(shares))]
                + [pa.array([s.rank_error() for s in rows], pa.float64())],
                names=[*keys, "count", *shares, "rank_error"],
            )

    schema = ", ".join([*(f"`{k}` string" for k in keys), "count long", *(f"`{s}` double" for s in shares), "rank_error double"])
    return parts.mapInArrow(run, schema)
