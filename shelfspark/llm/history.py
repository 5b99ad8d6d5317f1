"""Deduplicating new batches against all history (problem 1): a prefix-tree hash forest.

An entry is an identity (which file and segment, which UUID) and, for files, an instant. In tree ``j`` its signature is
the instant, shifted by ``j`` half spans, and its lead is the hash of identity, tree and the top bits of the signature
(a span of 2**32 microseconds). Sorted by lead and signature, all entries that share a prefix stand side by side.

* The forest is a set of runs of accepted entries. A run is a table in the shared folder, bucketed by lead and sorted by
  lead and signature, for both trees: two sorted permutations, of which the second holds what lies near an edge of a span
  of the first, as nothing else is asked of it.
* A batch entry is looked up by a range search. Its prefix begins at the whole signature and is widened bit by bit until
  the branch below it holds the wanted reach on either side; an entry that would have to leave its span takes the second
  tree, in which its span begins elsewhere. So every entry searches one range of one tree.
* The reach follows from the recall target: with the target 1 it is the tolerance, so no repeat can be missed; below 1 it
  is the smallest power of two that held the wanted share of the repeats found so far, once there are ``SEEN_LEAST``.
* The search is a semi-join on the lead with the range as its condition. The runs' buckets meet the batch where they lie:
  history is not shuffled for it, however large the batch is. Where few leads are asked for, these go
  into the scan and prune buckets and row groups. Leads are hashes, so a batch with an entry in every block of a run
  reads the whole run; a small batch reads as many blocks as it has entries (tests).
* What is found is verified by the identity's second hash and the distance of the instants.
* Runs are merged by ``FAN_IN`` of about the same size, so an entry is rewritten a logarithmic number of times.

Within a batch the rows are judged in their order: a row is accepted unless an accepted row stands closer than the
tolerance. Copies (same identity, same instant) are collapsed first. Rows and what was found for them are then sorted by
identity and instant inside blocks of one span, and each cluster of rows without a pause of the tolerance is judged by
one pass in order. Rows near the edge of a block are shown to the next block too; a row that depends on one of those that
is not judged yet stays open and is judged again with blocks that begin elsewhere. So a hot file spreads over its spans,
and a chain of rows takes one more round for each span that it crosses.

Nulls: rows without identity, or files without a known time or segment, are never repeats and are not stored. Rows
that arrive twice with one number count as one row. Empty input gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.session import fresh_path

TOLERANCE_US = 3_000_000
TREES = 2
#: A lead holds the entries of one identity in a span of 2 ** 32 microseconds (71 minutes): 1,432 accepted ones at most.
SPAN_BITS = 32
FAN_IN = 4
#: Rows of a run in one bucket; small runs have as many buckets as there are cores.
BUCKET_ROWS = 4_000_000
#: Leads that are given to the scan by name.
PRUNE_LEADS = 100
#: Repeats that must have been found before the reach follows from them.
SEEN_LEAST = 1_000

_KEY = ["record_table", "ident", "proof", "instant", "timed"]
_ENTRY = "record_table string, ident long, proof int, instant long, timed boolean, batch_no int, row_no long"
RUN_SCHEMA = _ENTRY + ", tree int, lead long, signature long"
VERDICT_SCHEMA = _ENTRY + ", first_no long, verdict string, far long"

_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
_UNSEEN = dict.fromkeys([0x200B, 0x200C, 0x200D, 0xFEFF, 0x00AD])


def plain_path(path: str | None) -> str | None:
    """One spelling for all ways to write a file's path on a disk that ignores letter case."""
    if path is None:
        return None
    text = path.translate(_UNSEEN).strip()
    if text[:5].lower() == "file:":
        text = text[5:]
        if text.startswith("//"):
            text = text[2:]
            text = text[9:] if text.lower().startswith("localhost/") else text
    if "%" in text and _PERCENT.search(text):
        try:
            text = unquote(text, errors="strict").translate(_UNSEEN).strip()
        except UnicodeDecodeError:
            pass
    text = unicodedata.normalize("NFC", text.replace("\\", "/").replace(chr(0xA0), " ")).lower()
    kept: list[str] = []
    for part in text.split("/"):
        if part == "..":
            if kept:
                kept.pop()
        elif part not in ("", "."):
            kept.append(part)
    return "/" + "/".join(kept) if kept else None


@F.pandas_udf(T.StringType())
def plain_paths(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for paths in parts:
        seen: dict[str | None, str | None] = {}
        yield pd.Series([seen[p] if p in seen else seen.setdefault(p, plain_path(p)) for p in paths], dtype=object)


def plain_uuid(key: Column) -> Column:
    """32 lower-case hex digits of a UUID in any of its usual spellings; null if it is none."""
    text = F.regexp_replace(F.lower(key), r"^[\s{]*(urn:)?(uuid:)?|[\s{}-]+", "")
    return F.when(text.rlike("^[0-9a-f]{32}$"), text)


def epoch_us(noted: Column) -> Column:
    """Microseconds since 1970 of a time noted in seconds, milliseconds, microseconds or nanoseconds; null if unknown."""
    known = noted.isNotNull() & ~F.isnan(noted) & (noted > 0) & (noted < 1e20)
    scale = F.when(noted < 1e11, noted * 1e6).when(noted < 1e14, noted * 1e3).when(noted < 1e17, noted).otherwise(noted / 1e3)
    return F.when(known, F.round(scale).cast("long"))


def entries_of(rows: DataFrame, record_table: str, batch_no: str, row_no: str, identity: Column, instant: Column | None) -> DataFrame:
    """(record_table, batch_no, row_no, ident, proof, instant) of the rows that have an identity.

    ``instant`` None says that entries have no time: they repeat if their identities are equal.
    """
    keyed = rows.select(
        F.lit(record_table).alias("record_table"),
        F.col(batch_no).cast("int").alias("batch_no"),
        F.col(row_no).cast("long").alias("row_no"),
        identity.alias("identity"),
        (F.lit(0).cast("long") if instant is None else instant).alias("instant"),
        F.lit(instant is not None).alias("timed"),
    ).where("identity is not null and instant is not null and batch_no is not null and row_no is not null")
    return keyed.select(
        "record_table", "batch_no", "row_no", F.xxhash64("record_table", "identity").alias("ident"), F.hash("identity", "record_table").alias("proof"), "instant", "timed"
    )


# --- signatures and ranges ----------------------------------------------------------


def _lead(signature: Column) -> Column:
    return F.xxhash64("ident", "tree", F.shiftright(signature, SPAN_BITS))


def permutations(entries: DataFrame, reach_us: int) -> DataFrame:
    """Adds (tree, signature, lead): one row per entry in the first tree, and one in the second for those near an edge of a span.

    A range search asks the second tree only for ranges that cross an edge of the first, so what it can find lies within twice the reach of one.
    """
    near = 2 * (reach_us - 1)
    crosses = F.shiftright(F.col("instant") - near, SPAN_BITS) != F.shiftright(F.col("instant") + near, SPAN_BITS)
    trees = F.when(F.col("timed") & crosses, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    shifted = entries.withColumn("tree", F.explode(trees)).withColumn("signature", F.col("instant") + F.col("tree").cast("long") * F.lit(1 << SPAN_BITS - 1))
    return shifted.withColumn("lead", _lead(F.col("signature")))


def ranges(entries: DataFrame, reach_us: int) -> DataFrame:
    """(tree, lead, low, high): the branch of one tree that holds all entries within the reach of an entry.

    ``high ^ low`` has as many bits as the prefix must drop until both ends of the reach lie below it.
    """
    reach = F.when(F.col("timed"), F.lit(reach_us - 1)).otherwise(F.lit(0))
    ends = entries.select("ident", (F.col("instant") - reach).alias("low"), (F.col("instant") + reach).alias("high"))
    crosses = F.shiftright("low", SPAN_BITS) != F.shiftright("high", SPAN_BITS)
    shift = crosses.cast("long") * F.lit(1 << SPAN_BITS - 1)
    placed = ends.select("ident", crosses.cast("int").alias("tree"), (F.col("low") + shift).alias("low"), (F.col("high") + shift).alias("high"))
    differ = F.col("low").bitwiseXOR(F.col("high"))
    widened = placed.withColumn("lead", _lead(F.col("low"))).withColumn("drop", F.when(differ == 0, 0).otherwise(F.length(F.bin(differ))))
    low = F.expr("shiftleft(shiftright(low, drop), drop)")
    return widened.select("tree", "lead", low.alias("low"), (low + F.expr("shiftleft(1L, drop)") - 1).alias("high"))


# --- the forest ---------------------------------------------------------------------


@dataclass(frozen=True)
class Run:
    """A sorted run: a bucketed table in the shared folder."""

    level: int
    table: str
    path: str
    rows: int
    buckets: int


class HashForest:
    """Sorted runs of accepted entries below one folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str | None = None, tolerance_us: int = TOLERANCE_US, recall: float = 1.0) -> None:
        if not 0 < 2 * tolerance_us < 1 << SPAN_BITS - 1:
            raise ValueError(f"a tolerance of {tolerance_us} does not fit into half a span")
        self.spark = spark
        self.path = path or fresh_path(spark, "forest")
        self.tolerance_us, self.recall = tolerance_us, recall
        self.runs: list[Run] = []
        #: Repeats found so far by the number of bits of their distance.
        self.distances = np.zeros(64, np.int64)
        self._name, self._made = f"forest_{uuid.uuid4().hex[:12]}", 0

    def reach(self) -> int:
        """Distance up to which accepted entries are looked for."""
        seen = int(self.distances.sum())
        if self.recall >= 1 or seen < SEEN_LEAST:
            return self.tolerance_us
        bits = int(np.searchsorted(np.cumsum(self.distances), self.recall * seen))
        return max(1, min(self.tolerance_us, 1 << bits))

    def candidates(self, entries: DataFrame) -> DataFrame | None:
        """Accepted entries in the ranges of a batch; one that stands in two trees may come twice.

        The semi-join is pushed below the union of the runs, so each run is met bucket by bucket.
        """
        if not self.runs:
            return None
        wanted = ranges(entries, self.reach()).select("lead", "low", "high")
        asked = wanted.select("lead").limit(PRUNE_LEADS + 1).collect()
        found: list[DataFrame] = []
        for buckets in {r.buckets for r in self.runs}:
            stored = self._together([r for r in self.runs if r.buckets == buckets])
            if len(asked) <= PRUNE_LEADS:
                stored = stored.where(F.col("lead").isin([r[0] for r in asked]))
                wanted = wanted.hint("merge")  # a broadcast would give up the buckets, by which the scan is pruned
            inside = (stored["lead"] == wanted["lead"]) & (stored["signature"] >= wanted["low"]) & (stored["signature"] <= wanted["high"])
            found.append(stored.join(wanted, inside, "left_semi").select(*_KEY, "batch_no", "row_no"))
        return reduce(DataFrame.unionByName, found)

    def _together(self, runs: list[Run]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.table(r.table) for r in runs])

    def add(self, accepted: DataFrame, count: int) -> None:
        """Write one sorted run; runs of one level are merged when there are ``FAN_IN`` of them."""
        if count:
            self._write(permutations(accepted, self.tolerance_us), count, 0)
        level = 0
        while len(old := [r for r in self.runs if r.level == level]) >= FAN_IN:
            self._write(self._together(old), sum(r.rows for r in old), level + 1)
            self.runs = [r for r in self.runs if r not in old]
            for run in old:
                self._drop(run)
            level += 1

    def _write(self, rows: DataFrame, count: int, level: int) -> None:
        run = Run(level, f"{self._name}_run_{self._made}", f"{self.path}/run-{self._made:05d}", count, self.spark.sparkContext.defaultParallelism)
        while run.buckets * BUCKET_ROWS < count:
            run = replace(run, buckets=2 * run.buckets)
        rows.repartition(run.buckets, "lead").write.bucketBy(run.buckets, "lead").sortBy("lead", "signature").option("path", run.path).saveAsTable(run.table)
        self._made += 1
        self.runs.append(run)

    def _drop(self, run: Run) -> None:
        """Forget a run of this forest that was merged into another, and delete its files."""
        self.spark.sql(f"drop table {run.table}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(run.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def rows(self) -> DataFrame:
        """The accepted entries of all runs."""
        every = self._together(self.runs) if self.runs else self.spark.createDataFrame([], RUN_SCHEMA)
        return every.where("tree = 0").select(*_KEY, "batch_no", "row_no")

    def ingest(self, batch: DataFrame) -> list[str]:
        """Judge one batch and add what it accepts. Returns the paths of its verdicts.

        A verdict (``VERDICT_SCHEMA``) is one per distinct entry of the batch: ``row_no`` is its first row, ``first_no``
        the accepted row it repeats. Rows whose verdict is ``open`` are judged again in the next round, for which what
        was found in the forest is kept as ``held``.
        """
        base = f"{self.path}/verdicts-{self._made:05d}-{uuid.uuid4().hex[:6]}"
        entries = batch.groupBy(*_KEY, "batch_no").agg(F.min("row_no").alias("row_no"))
        rows = entries.withColumn("held", F.lit(False))
        if (known := self.candidates(entries)) is not None:
            rows = rows.unionByName(known.withColumn("held", F.lit(True)))
        rounds: list[str] = []
        accepted = 0
        while True:
            rounds.append(f"{base}/round-{len(rounds)}")
            seen = Observation()
            verdict = F.col("verdict")
            counted = [F.count_if(verdict == v).alias(v) for v in ("accepted", "open")]
            bits = range(self.tolerance_us.bit_length() + 1) if self.recall < 1 else []
            distances = [F.count_if((verdict == "repeat") & F.col("far").between((1 << b) >> 1, (1 << b) - 1)).alias(f"far_{b}") for b in bits]
            judged_in_blocks(rows, self.tolerance_us, len(rounds) % 2 == 0).observe(seen, *counted, *distances).write.parquet(rounds[-1])
            counts = seen.get
            accepted += counts["accepted"]
            for b in bits:
                self.distances[b] += counts[f"far_{b}"]
            if not counts["open"]:
                break
            step = self.spark.read.schema(VERDICT_SCHEMA).parquet(rounds[-1])
            # what was accepted before in the same chains is held from now on
            chains = step.where(verdict == "open").select("ident").distinct()
            earlier = self.spark.read.schema(VERDICT_SCHEMA).parquet(*rounds).where(verdict.isin("accepted", "held"))
            still = step.where(verdict == "open").withColumn("held", F.lit(False)).unionByName(earlier.join(chains, "ident", "left_semi").withColumn("held", F.lit(True)))
            rows = still.select(*_KEY, "batch_no", "row_no", "held")
        judged = self.spark.read.schema(VERDICT_SCHEMA).parquet(*rounds)
        self.add(judged.where("verdict = 'accepted'").select(*_KEY, "batch_no", "row_no"), accepted)
        return rounds


# --- judging ------------------------------------------------------------------------


def judged_in_blocks(rows: DataFrame, tolerance_us: int, shifted: bool) -> DataFrame:
    """Verdicts on the rows (entry columns and ``held``, true for accepted ones), in blocks of one span of an identity."""
    at = F.col("instant") + F.lit((1 << SPAN_BITS - 1) * shifted)
    block = F.shiftright(at, SPAN_BITS)
    near = F.lit(tolerance_us - 1)
    blocks = F.when(F.col("timed"), F.array_distinct(F.array(block, F.shiftright(at - near, SPAN_BITS), F.shiftright(at + near, SPAN_BITS)))).otherwise(F.array(F.lit(0).cast("long")))
    placed = rows.select("*", F.posexplode(blocks).alias("halo", "block")).select(*_KEY, "batch_no", "row_no", "held", (F.col("halo") > 0).alias("halo"), "block")
    order = ["ident", "proof", "block"]
    return placed.repartition(*order).sortWithinPartitions(*order, "instant", "batch_no", "row_no").mapInArrow(_judge(tolerance_us), VERDICT_SCHEMA)


def _greedy(instants: list[int], order: list[tuple[int, int]], held: list[bool], halo: list[bool], tolerance_us: int) -> list[tuple[str | None, int]]:
    """(verdict, place of the row it repeats) for the rows of one cluster, which come sorted by instant.

    Rows are gone through in their order. A row of the halo that is not held may be accepted or not: what follows it
    within the tolerance is open, unless an accepted row comes before it in order.
    """
    out: list[tuple[str | None, int]] = [(None, -1)] * len(instants)
    accepted: list[tuple[int, int]] = []  # (instant, place)
    unknown: list[tuple[int, int]] = []

    def first(among: list[tuple[int, int]], instant: int) -> int:
        """Place of the first row in order among those closer than the tolerance; -1 if there is none."""
        lo, hi = bisect_left(among, (instant - tolerance_us + 1, -1)), bisect_left(among, (instant + tolerance_us, -1))
        return min((place for _, place in among[lo:hi]), key=order.__getitem__, default=-1)

    for place in sorted(range(len(order)), key=lambda i: (not held[i], order[i])):
        instant = instants[place]
        if held[place]:
            insort(accepted, (instant, place))
        elif halo[place]:
            insort(unknown, (instant, place))
        else:
            stands, maybe = first(accepted, instant), first(unknown, instant)
            if maybe >= 0 and (stands < 0 or order[maybe] < order[stands]):
                out[place] = "open", -1
                insort(unknown, (instant, place))
            elif stands >= 0:
                out[place] = "repeat", stands
            else:
                out[place] = "accepted", -1
                insort(accepted, (instant, place))
    return out


def _judge(tolerance_us: int) -> Callable:
    """Rows come sorted by identity, block and instant. A cluster ends where the next row is not closer than the tolerance."""
    verdicts = np.array(["accepted", "repeat", "open", "held"], object)

    def judge(rows: pa.Table) -> pa.RecordBatch:
        ident, proof, block, instant = (rows.column(c).to_numpy() for c in ("ident", "proof", "block", "instant"))
        number, held, halo = (rows.column(c).to_numpy() for c in ("row_no", "held", "halo"))
        batch = rows.column("batch_no").to_numpy()
        n = len(ident)
        new = np.concatenate(([True], _changes(ident, proof, block) | (np.diff(instant) >= tolerance_us)))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.concatenate((starts, [n])))
        code, first, far = np.zeros(n, np.int8), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        code[held] = 3
        emit = ~halo & ~held
        for lo, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            part = slice(lo, lo + size)
            if held[part].all():
                continue
            own = _greedy(instant[part].tolist(), list(zip(batch[part].tolist(), number[part].tolist(), strict=True)), held[part].tolist(), halo[part].tolist(), tolerance_us)
            opened = False
            for place, (verdict, of) in enumerate(own, lo):
                if verdict == "repeat":
                    code[place], first[place], far[place] = 1, number[lo + of], abs(int(instant[place] - instant[lo + of]))
                elif verdict == "open":
                    code[place], opened = 2, True
            if opened:
                emit[part] |= held[part] & ~halo[part]
        chosen = rows.filter(pa.array(emit))
        first, far = first[emit], far[emit]
        columns = [chosen.column(c).combine_chunks() for c in (*_KEY, "batch_no", "row_no")]
        columns += [pa.array(first, mask=first < 0), pa.array(verdicts[code[emit]], pa.string()), pa.array(far, mask=far < 0)]
        return pa.RecordBatch.from_arrays(columns, names=[*_KEY, "batch_no", "row_no", "first_no", "verdict", "far"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # the cluster that is not over yet
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [np.concatenate((waiting[-1].column(c).to_numpy()[-1:] if waiting else [], batch.column(c).to_numpy())) if waiting else batch.column(c).to_numpy() for c in ("ident", "proof", "block", "instant")]
            ends = np.flatnonzero(_changes(*keys[:3]) | (np.diff(keys[3]) >= tolerance_us)) + (0 if waiting else 1)
            if len(ends):
                last = int(ends[-1])
                yield judge(pa.Table.from_batches([*waiting, batch.slice(0, last)]))
                waiting = []
                batch = batch.slice(last)
            waiting.append(batch)
        if waiting:
            yield judge(pa.Table.from_batches(waiting))

    return run


def _changes(*columns: np.ndarray) -> np.ndarray:
    changed = np.zeros(max(0, len(columns[0]) - 1), bool)
    for column in columns:
        changed |= column[1:] != column[:-1]
    return changed


def repeats(spark: SparkSession, entries: DataFrame, batches: list[int], recall: float = 1.0) -> DataFrame:
    """Feed the batches to a new forest one after the other: (record_table, batch_no, row_no, first_no), first_no null where accepted.

    ``entries`` comes from :func:`entries_of` and should be a written table, as each batch is read from it by itself.
    """
    forest = HashForest(spark, recall=recall)
    verdicts = [path for number in batches for path in forest.ingest(entries.where(F.col("batch_no") == number))]
    if not verdicts:
        return entries.select("record_table", "batch_no", "row_no", F.lit(None).cast("long").alias("first_no")).limit(0)
    judged = (
        spark.read.schema(VERDICT_SCHEMA)
        .parquet(*verdicts)
        .where("verdict in ('accepted', 'repeat')")
        .select("record_table", "batch_no", "ident", "proof", "instant", "first_no", F.col("row_no").alias("lead_no"))
    )
    return entries.join(judged, ["record_table", "batch_no", "ident", "proof", "instant"]).select(
        "record_table",
        "batch_no",
        "row_no",
        F.when(F.col("first_no").isNotNull(), F.col("first_no")).when(F.col("row_no") != F.col("lead_no"), F.col("lead_no")).alias("first_no"),
    )
