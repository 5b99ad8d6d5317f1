"""Keyed state over streams: interval maps and their gaps, frames that look alike, sessions with a time limit, a drained queue."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from shelfspark.operators.intervals import BLOCK_MS, MAP_SCHEMA, IntervalMap, joined_blocks, partial_maps
from shelfspark.session import as_table, fresh_path


#: What a micro-batch changes in the maps: ``change`` is 1 for a period or gap that is there now, -1 for one that is no longer.
CHANGES = "record_table string, entity string, block long, span_kind string, start_ms long, end_ms long, change int"
#: Partial maps that one group of keys gets, over the whole stream.
GROUP_MAPS = 250


def interval_changes(parts: DataFrame, groups: int) -> DataFrame:
    """Changes of the periods and gaps of each (record_table, entity, block) by every micro-batch.

    ``parts`` streams rows of ``MAP_SCHEMA``. The state holds an ordered disjoint-interval map for each key; an insertion
    finds what it overlaps by binary search, merges it and so renews the gaps on either side. Keys are gathered in
    ``groups`` by a hash, so that calls into Python are paid by the group; a key includes a block of time, so a hot entity
    is spread over many groups. Late and repeated intervals change nothing that they should not: a map is a union. Only
    changes leave the stream, so a long map is not written again for each interval.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        maps: dict[tuple, tuple[list[int], list[int]]] = pickle.loads(state.get[0]) if state.exists else {}
        touched: dict[tuple, tuple[set, set]] = {}
        for frame in frames:
            for table, entity, block, starts, ends in zip(*(frame[c] for c in ("record_table", "entity", "block", "starts", "ends")), strict=True):
                at = table, entity, block
                held = IntervalMap(*maps.get(at, (None, None)))
                if at not in touched:
                    touched[at] = set(zip(held.starts, held.ends, strict=True)), set(held.gaps())
                for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
                    held.add(start, end)
                maps[at] = held.starts, held.ends
        state.update((pickle.dumps(maps),))
        rows = []
        for at, (periods, gaps) in touched.items():
            held = IntervalMap(*maps[at])
            for kind, old, new in (("period", periods, set(zip(held.starts, held.ends, strict=True))), ("gap", gaps, set(held.gaps()))):
                rows += [(*at, kind, *span, -1) for span in old - new] + [(*at, kind, *span, 1) for span in new - old]
        yield pd.DataFrame(rows, columns=["record_table", "entity", "block", "span_kind", "start_ms", "end_ms", "change"])

    keyed = parts.withColumn("group", F.pmod(F.xxhash64("record_table", "entity", "block"), F.lit(groups)))
    return keyed.groupBy("group").applyInPandasWithState(update, CHANGES, "maps binary", "update", GroupStateTimeout.NoTimeout)


def current_maps(changes: DataFrame) -> DataFrame:
    """The maps (``MAP_SCHEMA``) that all changes so far amount to."""
    key = ["record_table", "entity", "block"]
    spans = changes.repartition(*key).groupBy(*key, "span_kind", "start_ms", "end_ms").agg(F.sum("change").alias("there")).where("there > 0")
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("span_kind") == kind, F.struct("start_ms", "end_ms"))))
    return spans.groupBy(*key).agg(of("period").alias("periods"), of("gap").alias("gaps")).select(*key, F.col("periods.start_ms").alias("starts"), F.col("periods.end_ms").alias("ends"), F.col("gaps.end_ms").alias("gap_ends"))


def streamed_periods_and_gaps(intervals: DataFrame, micro_batches: int = 8, block_ms: int = BLOCK_MS) -> DataFrame:
    """(record_table, entity, span_kind, start_ms, end_ms): periods and gaps from the maps that a stream keeps.

    ``intervals`` (a table) is dealt out into arrivals, which a stream takes in one after the other. What reaches the
    stream are the maps that tasks have made of their rows, so a hot entity is small before it is shuffled.
    """
    spark = intervals.sparkSession
    arrivals, changes, progress = (fresh_path(spark, name) for name in ("arrivals", "changes", "progress"))
    partial_maps(intervals, block_ms).repartition(micro_batches).write.parquet(arrivals)
    parts = spark.read.schema(MAP_SCHEMA).parquet(arrivals).count()
    stream = spark.readStream.schema(MAP_SCHEMA).option("maxFilesPerTrigger", 1).parquet(arrivals)
    spark.createDataFrame([], CHANGES).withColumn("micro_batch", F.lit(-1)).write.parquet(f"{changes}/batch=none")
    run_to_table(interval_changes(stream, max(1, -(-parts // GROUP_MAPS))), changes, progress, "update")
    return joined_blocks(as_table(current_maps(spark.read.schema(CHANGES).parquet(changes)), "current-maps"))


def distinct_frames(frames: DataFrame, bits: int = 7, seconds: float = 20.0) -> DataFrame:
    """Frames of (video, at, hash) that differ from the frame accepted before them, or come late enough after it.

    A frame is dropped if its 64-bit hash (16 hex digits) differs in fewer than ``bits`` bits from the last accepted one
    and it follows within ``seconds``. Frames of one micro-batch are taken in the order of their times.
    """

    def accept(key: tuple, parts: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        last_hash, last_at = state.get if state.exists else (None, None)
        batch = pd.concat(list(parts)).sort_values(["at", "hash"])
        kept = []
        for at, code in zip(batch["at"], batch["hash"], strict=True):
            near = last_hash is not None and (int(code, 16) ^ int(last_hash, 16)).bit_count() < bits and 0 <= at - last_at < seconds
            if not near:
                kept.append((at, code))
                last_hash, last_at = code, at
        if last_hash is not None:
            state.update((last_hash, float(last_at)))
        yield pd.DataFrame({"video": [key[0]] * len(kept), "at": [float(k[0]) for k in kept], "hash": [k[1] for k in kept]})

    known = frames.where("video is not null and at is not null and hash is not null")
    return known.groupBy("video").applyInPandasWithState(accept, "video string, at double, hash string", "hash string, at double", "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, gap: str = "15 seconds", late: str = "1 minute") -> DataFrame:
    """Sessions of (key, at): they close after a pause, and are emitted once no earlier event can come."""
    return (
        events.withWatermark("at", late)
        .groupBy("key", F.session_window("at", gap).alias("session"))
        .agg(F.count("*").alias("events"))
        .select("key", F.col("session.start").alias("began"), F.col("session.end").alias("ended"), "events")
    )


def first_arrivals(events: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark; repeats are absorbed."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(key)


def drained(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand all waiting rows to a function, batch by batch, and stop; a batch that fails is given again on the next call."""
    query = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write what a stream gives for all waiting input to a Parquet folder, each micro-batch under its number, and stop."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("micro_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:06d}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
