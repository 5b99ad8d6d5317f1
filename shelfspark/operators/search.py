"""Top-k, deduplication and merging of recall lanes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.functions.text import boosted, lexical_boost, searchable_name
from shelfspark.functions.vectors import cosine, usable

MOST_RESULTS, DEFAULT_RESULTS = 500, 60
#: Query vectors that travel with the tasks of one scan, and scores that a task holds at a time.
QUERY_BLOCK, SCORE_CELLS = 20_000, 4_000_000


def bounded(limit: int | None, default: int = DEFAULT_RESULTS, most: int = MOST_RESULTS) -> int:
    """A limit within 1..most."""
    return max(1, min(most, int(limit if limit is not None else default)))


def top_k(rows: DataFrame, vector: str, query: list[float], key: str, limit: int | None = None) -> DataFrame:
    """The rows most similar to one query vector, which is a literal of the plan: no join, partial top-k in every task.

    Rows whose vector is null, of another dimension, not finite or all zero are left out. Ties go to the smaller key.
    """
    wanted = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.where(usable(F.col(vector), len(query))).withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(F.col(vector), wanted))))
    return scored.orderBy(F.desc("score"), key).limit(bounded(limit))


class _Best:
    """The k best neighbours of each query so far, ties by the smaller key."""

    def __init__(self, k: int, most: int) -> None:
        self.k, self.most, self.size = k, most, 0
        self.pool: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, query: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        self.pool.append((query, key, score))
        self.size += len(query)
        if self.size > self.most:
            self.pool = [self.kept()]
            self.size = len(self.pool[0][0])

    def kept(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, key, score = (np.concatenate(c) for c in zip(*self.pool, strict=True))
        order = np.lexsort((key, -np.round(score, 9), query))
        query, key, score = query[order], key[order], score[order]
        first = np.searchsorted(query, query, "left")
        top = np.arange(len(query)) - first < self.k
        return query[top], key[top], score[top]


def _nearest(by_space: dict[str, tuple[np.ndarray, np.ndarray]], dimension: int, k: int, cells: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k, max(cells, 2 * k * sum(len(q[0]) for q in by_space.values())))
        for batch in batches:
            names = batch.column(1).dictionary_encode()
            which = names.indices.to_numpy(zero_copy_only=False)
            for at, name in enumerate(names.dictionary.to_pylist()):
                numbers, wanted = by_space.get(name, (np.empty(0, np.int64), None))
                if not len(numbers):
                    continue
                mine = batch.filter(pa.array(which == at))
                keys = mine.column(0).to_numpy()
                values = mine.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(keys), dimension).astype(np.float64)
                values /= np.linalg.norm(values, axis=1, keepdims=True)
                step = max(1, cells // len(numbers))
                for lo in range(0, len(keys), step):
                    part = keys[lo : lo + step]
                    scores = wanted @ values[lo : lo + step].T
                    scores[numbers[:, None] == part] = -np.inf
                    # what ties with the k-th best stays, so that ties are settled by key in the end
                    cut = np.partition(scores, -min(k, len(part)), axis=1)[:, -min(k, len(part))]
                    q, r = np.nonzero((scores >= cut[:, None] - 1e-9) & np.isfinite(scores))
                    best.add(numbers[q], part[r], scores[q, r])
        if best.pool:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.kept()], names=["query_no", "neighbour_no", "score"])

    return run


def top_k_many(rows: DataFrame, vector: str, key: str, space: Column, queries: DataFrame, dimension: int, k: int, block: int = QUERY_BLOCK, cells: int = SCORE_CELLS) -> DataFrame:
    """(query_no, rank, neighbour_no, score): exact search of many queries (query_no, space, vector) against all rows.

    The queries are a stated set. They travel with the tasks in blocks of about ``block``, by a hash of their number, each
    of which scans the rows once. A task holds ``cells`` scores at a time and passes on ``k`` rows per query; the best of
    those are taken. A row is no neighbour of itself.
    """
    context = rows.sparkSession.sparkContext
    stated = queries.select("query_no", "space", "vector")
    blocks = max(1, -(-stated.count() // block))
    chosen = rows.select(F.col(key).cast("long").alias("key"), space.alias("space"), F.col(vector).cast("array<float>").alias("vector"))
    usable_rows = chosen.where(F.col("space").isNotNull() & usable(F.col("vector"), dimension))
    parts = []
    for number in range(blocks):
        own = stated if blocks == 1 else stated.where(F.pmod(F.xxhash64("query_no"), F.lit(blocks)) == number)
        by_space: dict[str, list] = {}
        for query in own.collect():  # one block
            by_space.setdefault(query.space, []).append(query)
        vectors = {name: np.array([q.vector for q in held], np.float64) for name, held in by_space.items()}
        shared = context.broadcast({name: (np.array([q.query_no for q in held], np.int64), vectors[name] / np.linalg.norm(vectors[name], axis=1, keepdims=True)) for name, held in by_space.items()})

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            return _nearest(shared.value, dimension, k, cells)(batches)

        parts.append(usable_rows.mapInArrow(run, "query_no long, neighbour_no long, score double"))
    best = W.partitionBy("query_no").orderBy(F.desc(F.round("score", 9)), "neighbour_no")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_no", "rank", "neighbour_no", "score")


def first_of(rows: DataFrame, identity: list[str], *order: Column) -> DataFrame:
    """One row per identity, the first in an order."""
    return rows.withColumn("_place", F.row_number().over(W.partitionBy(*identity).orderBy(*order))).where("_place = 1").drop("_place")


def best_passage(hits: DataFrame, path: Column, kind: Column, legacy: Column, hit_id: Column, score: Column, *ties: Column) -> DataFrame:
    """The best hit per document: live documents are one by path, anything else by its own id."""
    live_document = (kind == "document") & ~F.coalesce(legacy, F.lit(False))
    identity = F.when(live_document, F.concat(F.lit("document:"), path)).otherwise(hit_id)
    return first_of(hits.withColumn("_identity", identity), ["_identity"], F.desc(score), *ties).drop("_identity")


def capped_merge(hits: DataFrame, legacy: str, score: str, limit: int, *ties: Column) -> DataFrame:
    """The best of two lanes; the legacy lane may fill half of the result, rounded up, and loses ties."""
    old = F.coalesce(F.col(legacy), F.lit(False))
    ranked = best_per_lane(hits, old, score, limit, *ties)
    return ranked.where(~old | (F.col("lane_rank") <= -(-limit // 2))).orderBy(F.desc(score), old, *ties).limit(limit)


def best_per_lane(hits: DataFrame, lane: Column, score: str, most: int, *ties: Column) -> DataFrame:
    """The best hits of every lane with their ``lane_rank``, in one scan.

    The limit is a bound on a rank, which tasks apply before the shuffle (up to the session's threshold of 1000), so no
    lane is sorted whole in one task.
    """
    place = F.row_number().over(W.partitionBy(lane).orderBy(F.desc(score), *ties))
    return hits.withColumn("lane_rank", place).where(F.col("lane_rank") <= most)


def merged_sources(local: DataFrame, web: DataFrame, score: str, limit: int, *ties: Column) -> DataFrame:
    """Local and web hits by score; the local ones win ties. Both frames need the same columns."""
    both = local.withColumn("source", F.lit("local")).unionByName(web.withColumn("source", F.lit("web")))
    return both.orderBy(F.desc(score), "source", *ties).limit(limit)


def web_dedupe(hits: DataFrame, site: Column, video: Column, start: Column, lane: Column, score: str, text: str, *ties: Column) -> DataFrame:
    """One web hit per site, video and second: the best score, its own text or else the first text of the group.

    ``lane`` orders the hits: those of the visual lane come before those of the transcript lane.
    """
    keyed = hits.withColumns(
        {"_site": F.coalesce(F.nullif(site, F.lit("")), F.lit("youtube")), "_video": F.coalesce(video, F.lit("")), "_second": F.floor(F.coalesce(start, F.lit(0.0))), "_lane": lane}
    )
    group = W.partitionBy("_site", "_video", "_second")
    arrival = group.orderBy("_lane", *ties).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    held = F.first(F.nullif(F.col(text), F.lit("")), ignorenulls=True).over(arrival)
    filled = keyed.withColumn(text, F.coalesce(F.nullif(F.col(text), F.lit("")), held, F.lit("")))
    return first_of(filled, ["_site", "_video", "_second"], F.desc(score), "_lane", *ties).drop("_site", "_video", "_second", "_lane")


def with_lexical_boost(hits: DataFrame, query: Column, name: str, extension: Column, score: str) -> DataFrame:
    """Scores lifted by the file name and format that the query names."""
    named = hits.withColumns({"_wanted": searchable_name(query), "_own": searchable_name(F.col(name))})
    lifted = named.withColumn("boost", lexical_boost(query, F.col("_wanted"), F.col("_own"), extension)).drop("_wanted", "_own")
    return lifted.withColumn(score, boosted(F.col(score), F.col("boost")))


def reranked(hits: DataFrame, position: str, relevance: DataFrame, candidates: int = 20) -> DataFrame:
    """Order after a reranker: rated heads by relevance, then the other heads, then the tail, each in the old order.

    ``relevance`` has (position, relevance); positions outside the heads are ignored.
    """
    rated = relevance.where((F.col("position") >= 0) & (F.col("position") < candidates) & ~F.isnan("relevance")).groupBy("position").agg(F.max("relevance").alias("relevance"))
    joined = hits.join(rated.withColumnRenamed("position", position), position, "left")
    part = F.when(F.col("relevance").isNotNull(), 0).when(F.col(position) < candidates, 1).otherwise(2)
    return joined.withColumn("part", part).orderBy("part", F.desc_nulls_last("relevance"), position)


def page_of(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page of a sorted result; pages beyond the end give the last one with rows only through the caller's clamp."""
    return rows.orderBy(*order).offset(max(0, number - 1) * size).limit(size)
