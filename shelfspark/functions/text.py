"""Text expressions: normal forms, names to search in, lexical boosts, previews, prompts."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space at the ends of a text, for Java's regular expressions.
BLANK = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# How much a query that names a file format lifts files of that format.
_WORD = r"(?<![A-Za-z0-9_])(?:%s)(?![A-Za-z0-9_])"
FORMAT_BOOSTS = [
    (("csv",), _WORD % "csv" + "|表格|逗号分隔", 0.14),
    (("pdf",), _WORD % "pdf" + "|PDF文档|便携文档", 0.14),
    (("doc", "docx"), _WORD % "docx?|word" + "|Word文档", 0.12),
    (("md", "mdx"), _WORD % "mdx?" + "|markdown", 0.08),
    (("txt",), _WORD % "txt" + "|纯文本|文本文件", 0.08),
    (("json", "jsonl"), _WORD % "jsonl?" + "|结构化数据", 0.06),
    (("srt", "vtt"), _WORD % "srt|vtt" + "|字幕文件", 0.08),
]
EXACT_BOOST, TOKEN_BASE, TOKEN_SPAN, TOKEN_CAP, BOOST_CAP = 0.18, 0.04, 0.08, 0.12, 0.22


def trimmed(text: Column) -> Column:
    """Without white space of any script at its ends."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def normalized_text(text: Column) -> Column:
    """Line ends as LF, tabs and NULs as spaces, no space before a line end, at most three line ends in a row, trimmed."""
    # The steps and their order, which decide on every offset.
    steps = [(r"\r\n?", "\n"), (r"\x00", " "), (r"[\t\f\x0B]+", " "), (r"[ \x{A0}]+\n", "\n"), (r"\n{4,}", "\n\n\n")]
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return trimmed(text)


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, f"{BLANK}+", " "))


@F.pandas_udf(T.StringType())
def nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition, for which there is no expression."""
    for texts in parts:
        yield texts.map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) and not t.isascii() else t)


def searchable_name(name: Column) -> Column:
    """Compatibility forms folded, lower case, without a file extension, anything but letters and digits as one space."""
    base = F.lower(nfkc(name))
    base = F.regexp_replace(base, r"\.[a-z0-9]{1,8}$", "")
    return F.trim(F.regexp_replace(base, r"[^\p{L}\p{N}]+", " "))


def lexical_boost(query: Column, wanted: Column, own: Column, extension: Column) -> Column:
    """Lift of a hit whose file name stands in the query, plus that of a named file format; 0 where either is blank.

    ``wanted`` and ``own`` are the searchable forms of query and name, as columns of a frame: they are made in Python,
    which the functions over their words cannot hold.
    """
    tokens = F.filter(F.split(own, " "), lambda t: F.length(t) >= 2)
    matched = F.size(F.filter(tokens, lambda t: F.contains(wanted, t)))
    share = F.least(F.lit(TOKEN_CAP), F.lit(TOKEN_BASE) + F.lit(TOKEN_SPAN) * matched / F.greatest(F.size(tokens), F.lit(1)))
    base = F.when(F.contains(wanted, own), F.lit(EXACT_BOOST)).when(matched > 0, share).otherwise(0.0)
    form = F.lit(0.0)
    for extensions, pattern, lift in reversed(FORMAT_BOOSTS):
        form = F.when(F.lower(extension).isin(*extensions) & query.rlike(f"(?i){pattern}"), F.lit(lift)).otherwise(form)
    return F.when((wanted == "") | (own == "") | wanted.isNull() | own.isNull(), 0.0).otherwise(F.least(F.lit(BOOST_CAP), base + form))


def boosted(score: Column, boost: Column) -> Column:
    """Score after the lift: never above 1, never below the score."""
    return F.greatest(score, F.least(F.lit(1.0), score + boost))


def preview(text: Column, limit: int = 280) -> Column:
    """The beginning of a text in one line."""
    return F.substring(collapsed(text), 1, limit)


def space_slug(model: Column, dimension: Column, style: Column, version: str) -> Column:
    """Name of an embedding space from the model, its dimension, its input style and the version of the naming."""
    text = F.concat_ws("-", F.lower(model), dimension.cast("string"), style, F.lit(version))
    return F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9._-]+", "-"), r"^-+|-+$", "")


def input_style(model: Column, style: Column, family: str, other: str) -> Column:
    """The input style asked for; ``auto`` is that of a model family where the model's name holds it, else another."""
    return F.when(style.isNull() | style.isin("", "auto"), F.when(F.contains(F.lower(model), F.lit(family)), family).otherwise(other)).otherwise(style)


def safe_name(name: Column, limit: int = 24) -> Column:
    """Letters, digits, dash and underscore only, cut to a length."""
    return F.substring(F.regexp_replace(F.lower(name), r"[^a-z0-9_-]+", "_"), 1, limit)


def messages(style: Column, instruction: Column, text: Column, joined_style: str) -> Column:
    """Chat messages of an embedding request: one user message in the joined style, else system and user."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    one = F.array(message("user", F.concat_ws("\n", instruction, text)))
    return F.when(style == joined_style, one).otherwise(F.array(message("system", instruction), message("user", text)))
