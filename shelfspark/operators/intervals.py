"""Continuous periods and gaps of overlapping, nested and gapped intervals.

Three steps, none of which puts all intervals of one entity into one task:

1. Every task keeps one ordered disjoint-interval map per (entity, block of start times). An insertion finds what it
   overlaps by binary search and merges it. What leaves the task is already merged, so a hot entity shrinks before the
   shuffle.
2. The maps of one (entity, block) are merged the same way. The key holds the block, so an entity with a third of all
   rows spreads over as many tasks as it has blocks. In ``streaming/keyed.py`` these maps and their gaps are the state of
   a stream, into which the maps of each micro-batch are inserted.
3. Blocks are joined up through a summary of one row per (entity, block): the furthest end of all earlier blocks tells
   which leading intervals of a block belong to a period that began before it.

Rows: ``entity`` or a bound that is null or NaN, and ends not after their start, carry no interval. Bounds are whole
numbers (the caller rounds). Intervals that overlap or touch form one period. An empty input gives an empty result.
Other columns of the input are not looked at, so their names cannot clash.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.session import as_table

#: One hour. A block holds the intervals that start in it; it bounds what one key can hold.
BLOCK_MS = 3_600_000
#: A task passes its maps on when they hold this many intervals together, so its memory is bounded.
FLUSH_INTERVALS = 200_000

#: One map of an entity and block: its intervals, and for each but the last where the gap behind it ends.
MAP_SCHEMA = "record_table string, entity string, block long, starts array<long>, ends array<long>, gap_ends array<long>"


class IntervalMap:
    """Ordered disjoint closed intervals. Touching intervals are one."""

    __slots__ = ("ends", "starts")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None) -> None:
        self.starts = starts or []
        self.ends = ends or []

    def add(self, start: int, end: int) -> int:
        """Insert one interval; returns by how many intervals the map grew (it may shrink)."""
        starts, ends = self.starts, self.ends
        if not starts or start > ends[-1]:
            starts.append(start)
            ends.append(end)
            return 1
        lo = bisect_left(ends, start)
        hi = bisect_right(starts, end)
        if lo == hi:
            starts.insert(lo, start)
            ends.insert(lo, end)
            return 1
        if starts[lo] < start:
            start = starts[lo]
        if ends[hi - 1] > end:
            end = ends[hi - 1]
        starts[lo:hi] = [start]
        ends[lo:hi] = [end]
        return 1 - (hi - lo)

    def gaps(self) -> list[tuple[int, int]]:
        """What lies between consecutive intervals."""
        return list(zip(self.ends[:-1], self.starts[1:], strict=True))


def _batch(maps: dict[tuple, IntervalMap]) -> pa.RecordBatch:
    keys = list(maps)
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.string()),
            pa.array([k[1] for k in keys], pa.string()),
            pa.array([k[2] for k in keys], pa.int64()),
            pa.array([m.starts for m in maps.values()], longs),
            pa.array([m.ends for m in maps.values()], longs),
            pa.array([m.starts[1:] for m in maps.values()], longs),
        ],
        names=["record_table", "entity", "block", "starts", "ends", "gap_ends"],
    )


def _rows_to_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    maps: dict[tuple, IntervalMap] = {}
    held = 0
    for batch in batches:
        for table, entity, block, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = maps.get((table, entity, block))
            if found is None:
                found = maps[table, entity, block] = IntervalMap()
            held += found.add(start, end)
        if held > FLUSH_INTERVALS:
            yield _batch(maps)
            maps, held = {}, 0
    if maps:
        yield _batch(maps)


def _merge_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key, so only the map of the current key is open."""
    done: dict[tuple, IntervalMap] = {}
    held, key, current = 0, None, IntervalMap()
    for batch in batches:
        for table, entity, block, starts, ends in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
            if (table, entity, block) != key:
                if key is not None:
                    done[key] = current
                    held += len(current.starts)
                if held > FLUSH_INTERVALS:
                    yield _batch(done)
                    done, held = {}, 0
                key, current = (table, entity, block), IntervalMap(starts, ends)
            else:
                for start, end in zip(starts, ends, strict=True):
                    current.add(start, end)
    if key is not None:
        done[key] = current
        yield _batch(done)


def whole_ms(seconds: Column) -> Column:
    """Seconds to whole milliseconds, halves away from zero; null where missing or not finite."""
    ms = F.round(seconds * 1000)
    return F.when(F.isnan(seconds) | (F.abs(seconds) > 9.0e12), None).otherwise(ms.cast("long"))


def intervals_of(df: DataFrame, record_table: str, entity: str, start_seconds: str, end_seconds: str) -> DataFrame:
    """The usable intervals of a table as (record_table, entity, start_ms, end_ms)."""
    return df.select(
        F.lit(record_table).alias("record_table"),
        F.col(entity).cast("string").alias("entity"),
        whole_ms(F.col(start_seconds)).alias("start_ms"),
        whole_ms(F.col(end_seconds)).alias("end_ms"),
    ).where("entity is not null and start_ms is not null and end_ms > start_ms")


def partial_maps(intervals: DataFrame, block_ms: int = BLOCK_MS) -> DataFrame:
    """Maps of (record_table, entity, block) as each task finds them; several tasks may have one of the same key."""
    keyed = intervals.where(
        "entity is not null and start_ms is not null and end_ms is not null and end_ms > start_ms"
    ).select(
        "record_table", "entity", F.floor(F.col("start_ms") / F.lit(block_ms)).cast("long").alias("block"), "start_ms", "end_ms"
    )
    return keyed.mapInArrow(_rows_to_maps, MAP_SCHEMA)


def block_maps(intervals: DataFrame, block_ms: int = BLOCK_MS) -> DataFrame:
    """One ordered disjoint-interval map per (record_table, entity, block)."""
    return (
        partial_maps(intervals, block_ms).repartition("record_table", "entity", "block")
        .sortWithinPartitions("record_table", "entity", "block")
        .mapInArrow(_merge_maps, MAP_SCHEMA)
    )


def periods_and_gaps(intervals: DataFrame, block_ms: int = BLOCK_MS) -> DataFrame:
    """(record_table, entity, span_kind, start_ms, end_ms) of the periods and the gaps of each entity."""
    return joined_blocks(as_table(block_maps(intervals, block_ms), "interval-maps"))


def joined_blocks(maps: DataFrame) -> DataFrame:
    """Periods and gaps from the maps of all blocks, which should be a written table as it is read twice."""
    key = ["record_table", "entity", "block"]
    entity = W.partitionBy("record_table", "entity").orderBy("block")
    before = maps.select(*key, F.array_max("ends").alias("furthest")).select(
        *key,
        F.max("furthest").over(entity.rowsBetween(W.unboundedPreceding, -1)).alias("carry"),
        F.max("furthest").over(W.partitionBy("record_table", "entity")).alias("last_end"),
    )
    blocks = maps.join(before, key).withColumn(
        "absorbed", F.when(F.col("carry").isNull(), 0).otherwise(F.size(F.filter("starts", lambda s: s <= F.col("carry"))))
    )
    opens = F.col("absorbed") < F.size("starts")
    summary = blocks.select(
        *key,
        F.when(
            opens,
            F.struct(
                F.element_at("starts", F.col("absorbed") + 1).alias("next_start"),
                F.greatest("carry", F.array_max(F.slice("ends", 1, F.col("absorbed")))).alias("close"),
            ),
        ).alias("opening"),
    ).select(
        *key,
        F.first("opening", ignorenulls=True).over(entity.rowsBetween(1, W.unboundedFollowing)).alias("following"),
    )
    new = (
        blocks.where(opens)
        .join(summary, key)
        .select(
            "record_table",
            "entity",
            F.posexplode(
                F.arrays_zip(
                    F.slice("starts", F.col("absorbed") + 1, F.size("starts")).alias("s"),
                    F.slice("ends", F.col("absorbed") + 1, F.size("ends")).alias("e"),
                    F.concat(
                        F.slice("gap_ends", F.col("absorbed") + 1, F.size("starts")),
                        F.array(F.col("following.next_start")),
                    ).alias("n"),
                )
            ).alias("at", "span"),
            (F.size("starts") - F.col("absorbed") - 1).alias("last_at"),
            F.coalesce("following.close", "last_end").alias("tail_end"),
        )
        .select(
            "record_table",
            "entity",
            F.col("span.s").alias("s"),
            F.when(F.col("at") == F.col("last_at"), F.col("tail_end")).otherwise(F.col("span.e")).alias("e"),
            F.col("span.n").alias("n"),
        )
    )
    return new.select(
        "record_table",
        "entity",
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.lit("period").alias("span_kind"), F.col("s").alias("start_ms"), F.col("e").alias("end_ms")),
                    F.when(
                        F.col("n").isNotNull(),
                        F.struct(F.lit("gap").alias("span_kind"), F.col("e").alias("start_ms"), F.col("n").alias("end_ms")),
                    ),
                )
            )
        ).alias("span"),
    ).select("record_table", "entity", "span.span_kind", "span.start_ms", "span.end_ms")
