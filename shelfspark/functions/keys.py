"""Deterministic keys and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the name space of URLs in RFC 9562.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5_url(name: Column) -> Column:
    """UUID version 5 of a name in the URL name space."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    part = lambda at, n: F.substring(digest, at, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(19, 2)), part(21, 12))


def asset_key(path: Column, segment: Column, space: Column) -> Column:
    """Key of one segment of a file in one embedding space."""
    return uuid5_url(F.concat(F.lit("asset:"), path, F.lit(":"), segment.cast("string"), F.lit(":"), space))


def segment_key(site: Column, kind: Column, video: Column, schema: Column, segment: Column, space: Column) -> Column:
    """Key of one segment of a captured video."""
    return uuid5_url(F.concat_ws(":", site, kind, video, schema, segment.cast("string"), space))


def collection_name(index: Column, space: Column) -> Column:
    """Physical name of a collection: readable part and digest of the exact pair, so that look-alike names stay apart."""
    readable = F.substring(F.regexp_replace(index, r"[^A-Za-z0-9_]+", "_"), 1, 24)
    return F.concat(F.lit("v2_"), readable, F.lit("_"), F.sha2(F.concat(index, F.lit("\x1f"), space), 256))


def short_digest(*parts: Column) -> Column:
    """First 24 hex digits of the digest of several values, told apart by a separator."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 24)


def fingerprint(size: Column, modified_ms: Column) -> Column:
    """``size:time``, the time rounded half up as in the stored rows."""
    return F.concat(size.cast("string"), F.lit(":"), F.floor(modified_ms + 0.5).cast("string"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes given as 16 hex digits; 64 where one is missing."""
    return F.coalesce(F.bit_count(F.conv(a, 16, -10).cast("long").bitwiseXOR(F.conv(b, 16, -10).cast("long"))), F.lit(64))


def set_token(key: Column) -> Column:
    """A token of a set of keys, as an aggregate: it does not depend on their order, so no set is gathered in one place."""
    number = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("decimal(38,0)")
    return F.sum(number).cast("string")
