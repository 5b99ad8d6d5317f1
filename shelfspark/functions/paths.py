"""File names, kinds and folders as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extensions of each kind of asset and the folders that scans pass by.
KINDS = {
    "video": ("mp4", "mov", "mkv", "webm", "m4v"),
    "image": ("jpg", "jpeg", "png", "webp", "gif", "heic", "avif"),
    "document": ("pdf", "doc", "docx", "md", "mdx", "txt", "json", "jsonl", "csv", "srt", "vtt", "ts", "tsx", "js", "jsx", "py", "html", "css"),
}
SIDECARS = ("txt", "srt", "vtt", "md", "json", "csv")
EDITABLE = ("md", "mdx", "txt", "json", "jsonl", "csv", "srt", "vtt")
SKIPPED_FOLDERS = ("build", "dist", "node_modules", "out", "target", "venv", "__pycache__")
GENERIC_FOLDERS = r"(?i)^(assets?|media|videos?|files?|renders?|output|out|clips?|素材)$"
MIME = {
    "mp4": "video/mp4",
    "mov": "video/quicktime",
    "m4v": "video/x-m4v",
    "mkv": "video/x-matroska",
    "webm": "video/webm",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "webp": "image/webp",
    "gif": "image/gif",
    "heic": "image/heic",
    "avif": "image/avif",
    "pdf": "application/pdf",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
MEDIA = KINDS["video"] + KINDS["image"]


def extension(path: Column) -> Column:
    """Lower-case extension of the last part of a path, or an empty string."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def kind_of(ext: Column, other: str = "") -> Column:
    """Kind of asset of an extension."""
    found = F.lit(other)
    for kind, extensions in KINDS.items():
        found = F.when(ext.isin(*extensions), kind).otherwise(found)
    return found


def mime_of(ext: Column) -> Column:
    """Content type of an extension."""
    pairs = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.element_at(pairs, ext), F.lit("application/octet-stream"))


def folder(path: Column) -> Column:
    """All but the last part of a path."""
    return F.regexp_replace(path, r"/[^/]*$", "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """Lower-case name without its extension."""
    return F.lower(F.regexp_replace(file_name(path), r"\.[^.]*$", ""))


def passed_by(path: Column) -> Column:
    """Whether a scan passes by: a hidden part, or a folder of built or fetched files."""
    return F.exists(F.split(path, "/"), lambda part: F.startswith(part, F.lit(".")) | part.isin(*SKIPPED_FOLDERS))


def inside(path: Column, root: Column) -> Column:
    """Whether a path is a root or lies below it."""
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def ancestors(path: Column) -> Column:
    """The path and every folder above it, so that "below a root" is an equality join instead of a prefix join."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))


def folder_label(path: Column) -> Column:
    """Name of a folder; a generic one with its parent before it."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    last = F.element_at(parts, -1)
    return F.when(F.size(parts) == 0, "/").when(last.rlike(GENERIC_FOLDERS) & (F.size(parts) > 1), F.concat_ws("/", F.element_at(parts, -2), last)).otherwise(last)
