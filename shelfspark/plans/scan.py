"""An incremental scan: what changed on disk is chunked, embedded and stored, what vanished is removed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.keys import asset_key
from shelfspark.functions.plugins import Embedder, embedding
from shelfspark.functions.text import preview
from shelfspark.operators.chunking import document_chunks
from shelfspark.operators.library import scan_states, stale_keys
from shelfspark.operators.store import VectorStore
from shelfspark.session import as_table


@dataclass
class ScanResult:
    """Counters of one scan. What was pending is taken_in, incomplete or remaining; incomplete files had no text, or a chunk without a vector."""

    discovered: int
    taken_in: int
    skipped: int
    removed: int
    remaining: int
    vectors: int
    incomplete: int = 0


def _known(recorded: DataFrame, held: DataFrame, texts: DataFrame) -> DataFrame:
    """(root, path, fingerprint, current): what is in the index, from the files taken in; from the rows where a file was never recorded.

    A recorded file is current if all its chunks are stored still, and if it had no text, as long as there is none.
    """
    stored = held.groupBy("path", "fingerprint").agg(F.count("*").alias("stored"))
    whole = (F.coalesce("stored", F.lit(0)) == F.col("vectors")) & (F.col("chunks") == F.col("vectors"))
    rows = recorded.join(stored, ["path", "fingerprint"], "left").withColumn("whole", whole)
    if recorded.where("not has_text").isEmpty():
        current = rows.withColumn("current", F.col("whole"))
    else:
        # texts are read here only if there are files to which one may have come
        late = texts.where("text is not null").select("path").distinct().withColumn("late", F.lit(True))
        current = rows.join(late, "path", "left").withColumn("current", F.col("whole") & (F.col("has_text") | F.col("late").isNull()))
    columns = ["root", "path", "fingerprint", "current"]
    return current.select(*columns).unionByName(held.withColumn("current", F.lit(True)).join(recorded.select("path"), "path", "left_anti").select(*columns))


def scan(store: VectorStore, index: str, space: str, root: str, files: DataFrame, texts: DataFrame, embedder: Embedder, most_files: int = 400, now_ms: int = 0, dry_run: bool = False) -> ScanResult:
    """Take in at most ``most_files`` new or changed files of a root, first by path, and remove those that are gone.

    ``files`` has (root, path, fingerprint), ``texts`` (path, text). Keys follow from path and chunk, so a scan that was
    cut off and runs again writes the same rows. Only what is taken in reaches the embedder. Every file taken in is
    recorded, also without a chunk, so none fills the budget of the next scan; a file with a chunk that got no vector is
    tried again, after all that were tried less often.
    """
    held = store.read(index, space).select("key", F.col("metadata.root").alias("root"), F.col("metadata.path").alias("path"), F.col("metadata.fingerprint").alias("fingerprint")).where(F.col("root") == root)
    every = store.files(index, space)
    recorded = every.where(F.col("root") == root)
    own = files.where(F.col("root") == root)
    states = as_table(scan_states(own, _known(recorded, held, texts)), "states")
    counts = {r[0]: r[1] for r in states.groupBy("state").count().collect()}
    discovered, skipped = counts.get("pending", 0) + counts.get("skipped", 0), counts.get("skipped", 0)
    pending = own.join(states.where("state = 'pending'"), "path", "left_semi").join(recorded.select("path", "fingerprint", "tries"), ["path", "fingerprint"], "left")
    taken = as_table(pending.select("path", "fingerprint", F.coalesce("tries", F.lit(0)).alias("tries")).orderBy("tries", "path").limit(most_files), "taken")
    gone = held.join(states.where("state = 'vanished'"), "path", "left_semi").select("path", "key")
    begun = taken.count()
    remaining = counts.get("pending", 0) - begun
    if dry_run:
        return ScanResult(discovered, begun, skipped, gone.select("path").distinct().count(), remaining, 0)
    removed = as_table(gone, "gone")
    bodies = as_table(taken.join(texts.select("path", "text"), "path", "left").select("path", "text"), "bodies")
    chunks = document_chunks(bodies, "path", "text").withColumnRenamed("key", "path").join(taken.select("path", "fingerprint"), "path")
    # with the chunks that got no vector, which are counted below
    embedded = as_table(
        chunks.select(
            asset_key(F.col("path"), F.col("chunk_index"), F.lit(space)).alias("key"),
            embedding(embedder)("text").alias("vector"),
            F.create_map(
                F.lit("root"), F.lit(root), F.lit("path"), "path", F.lit("fingerprint"), "fingerprint", F.lit("segment_index"), F.col("chunk_index").cast("string"), F.lit("text_preview"), preview(F.col("text"))
            ).alias("metadata"),
            F.lit(now_ms).cast("long").alias("written_ms"),
            "path",
        ),
        "embedded",
    )
    rows = embedded.where("vector is not null")
    stale = as_table(stale_keys(held.select("path", "key"), rows.select("path", "key"), taken).select("key"), "stale")
    found = bodies.groupBy("path").agg(F.max(F.col("text").isNotNull()).alias("has_text"))
    sizes = embedded.groupBy("path").agg(F.count("*").alias("chunks"), F.count("vector").alias("vectors"))
    read = as_table(
        taken.join(found, "path")
        .join(sizes, "path", "left")
        .select(F.lit(root).alias("root"), "path", "fingerprint", "has_text", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("vectors", F.lit(0)).alias("vectors"), (F.col("tries") + 1).alias("tries")),
        "read",
    )
    vectors = store.upsert(index, space, rows.drop("path"))
    store.delete(index, space, removed.select("key").unionByName(stale))
    # last: what was cut off before this is pending again
    left = states.where("state = 'vanished'").select("root", "path").unionByName(read.select("root", "path"))
    store.replace_files(index, space, every.join(left, ["root", "path"], "left_anti").unionByName(read))
    taken_in = read.where("has_text and chunks = vectors").count()
    return ScanResult(discovered, taken_in, skipped, removed.select("path").distinct().count(), remaining, vectors, begun - taken_in)
