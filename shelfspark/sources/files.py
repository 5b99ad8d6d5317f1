"""Folders as tables of files, and readers of what is in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.keys import fingerprint
from shelfspark.functions.paths import extension, file_name, kind_of, passed_by, stem
from shelfspark.functions.text import normalized_text

MOST_TEXT_BYTES, MOST_IMAGE_BYTES, MOST_EDITED_BYTES, MOST_DEPTH = 64 << 20, 32 << 20, 1 << 20, 12


def _below(path: Column, root: str) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^file:/*", "/"), "^" + root.rstrip("/").replace("\\", "\\\\").replace(".", "\\.") + "/", "")


def walk(spark: SparkSession, root: str, kinds: tuple[str, ...] = ("video", "image", "document"), depth: int = MOST_DEPTH) -> DataFrame:
    """Files below a root of the tracked kinds: path, name, kind, size, time and fingerprint. Contents are not read.

    Hidden parts, folders of built files and paths that are too deep are passed by. An empty root gives no rows.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    relative = _below(F.col("path"), root)
    ext = extension(F.col("path"))
    found = listed.select(
        relative.alias("relative_path"),
        file_name(F.col("path")).alias("name"),
        ext.alias("extension"),
        stem(F.col("path")).alias("stem"),
        kind_of(ext).alias("kind"),
        F.col("length").alias("size"),
        F.unix_millis("modificationTime").alias("modified_ms"),
        "path",
    )
    kept = found.where(F.col("kind").isin(*kinds) & ~passed_by(F.col("relative_path")) & (F.size(F.split("relative_path", "/")) <= depth + 1))
    return kept.withColumn("fingerprint", fingerprint(F.col("size"), F.col("modified_ms")))


def plain_texts(spark: SparkSession, root: str, most_bytes: int = MOST_TEXT_BYTES) -> DataFrame:
    """(path, text, problem): normalised text of every plain file, or why there is none."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = rows.where(extension(F.col("path")).isin("txt", "md", "mdx", "json", "jsonl", "csv", "srt", "vtt", "ts", "tsx", "js", "jsx", "py", "html", "css"))
    problem = (
        F.when(F.col("length") > most_bytes, "too large")
        .when(F.contains("content", F.lit(b"\x00")), "binary")
        .when(~F.is_valid_utf8("content"), "not UTF-8")
    )
    text = normalized_text(F.decode("content", "UTF-8"))
    checked = plain.select("path", problem.alias("problem"), F.when(problem.isNull(), text).alias("text"))
    return checked.select("path", F.nullif("text", F.lit("")).alias("text"), F.coalesce("problem", F.when(F.col("text") == "", "empty")).alias("problem"))


def images(spark: SparkSession, root: str, most_bytes: int = MOST_IMAGE_BYTES) -> DataFrame:
    """(path, content) of the images that are not too large; the limit on the size is applied before a file is read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= most_bytes)
    return rows.where(kind_of(extension(F.col("path"))) == "image").select("path", "content")


def formats(word: bool = False, pdf: bool = False) -> list[dict[str, object]]:
    """Groups of document formats and whether a reader for them is plugged in."""
    return [
        {"id": "plain", "extensions": ["txt", "md", "mdx", "json", "jsonl", "csv", "srt", "vtt"], "available": True},
        {"id": "word", "extensions": ["doc", "docx"], "available": word},
        {"id": "pdf", "extensions": ["pdf"], "available": pdf},
    ]


def history(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a stored history, one JSON object per line; lines of other versions or forms are dropped."""
    schema = "version int, workload_key string, provider_key string, elapsed_ms long, concurrency int, sampled_at_ms long"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.where("version = 1 and workload_key is not null and elapsed_ms > 0 and concurrency >= 1")


def caption_events(payload: Column) -> Column:
    """Cues of a caption timeline in JSON: array of (start_seconds, end_seconds, caption)."""
    schema = "struct<events:array<struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string>>>>>"
    events = F.coalesce(F.from_json(payload, schema).getField("events"), F.array().cast("array<struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string>>>>"))
    return F.transform(
        F.filter(events, lambda e: e["segs"].isNotNull()),
        lambda e: F.struct(
            (F.coalesce(e["tStartMs"], F.lit(0)) / 1000).alias("start_seconds"),
            ((F.coalesce(e["tStartMs"], F.lit(0)) + F.coalesce(e["dDurationMs"], F.lit(0))) / 1000).alias("end_seconds"),
            F.array_join(F.transform(e["segs"], lambda s: F.coalesce(s["utf8"], F.lit(""))), "").alias("caption"),
        ),
    )
