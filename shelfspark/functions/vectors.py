"""Vectors as expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def usable(a: Column, dimension: int) -> Column:
    """The right number of values, all finite, not all zero."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return a.isNotNull() & (F.size(a) == dimension) & ~bad & F.exists(a, lambda x: x != 0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(0.0)


def score_of(distance: Column) -> Column:
    """Score of a cosine distance: 1 less the distance, within -1..1; a missing distance counts as 0."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.coalesce(distance, F.lit(0.0))))


def shortened(a: Column, dimension: int) -> Column:
    """The first values, scaled to length 1."""
    head = F.slice(a, 1, dimension)
    return F.transform(head, lambda x: F.when(norm(head) > 0, x / norm(head)).otherwise(F.lit(0.0)))
