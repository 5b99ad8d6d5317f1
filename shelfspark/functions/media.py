"""Times, addresses, chunk plans and sizes of media as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens of a frame, share of the context for frames, default context.
TOKENS_PER_FRAME, FRAME_SHARE, CONTEXT = 110, 0.5, 32768


def finite(value: Column, otherwise: float = 0.0) -> Column:
    """The number, or another where it is missing, NaN or infinite."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), F.lit(otherwise)).otherwise(number)


def frame_budget(context: Column) -> Column:
    """Frames that fit into the share of a context."""
    usable = F.when((finite(context) > 0), F.floor(finite(context))).otherwise(CONTEXT)
    return F.greatest(F.lit(1), F.floor(usable * FRAME_SHARE / TOKENS_PER_FRAME)).cast("int")


def chunk_plan(duration: Column, context: Column, chunk: int = 30, longest: int = 60, fps: int = 2, most: int = 240) -> Column:
    """Struct of the chunk length and the segments that cover 0..duration without a gap; null for a duration that is not positive and finite."""
    budget = frame_budget(context)
    limit = F.greatest(F.lit(1), F.least(F.lit(max(longest, chunk)), F.floor(budget / fps)))
    wanted = F.greatest(F.lit(1), F.least(F.lit(chunk), limit))
    seconds = finite(duration)
    length = F.when(F.ceil(seconds / wanted) > most, F.ceil(seconds / most)).otherwise(wanted).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(seconds / length).cast("long") - 1, F.lit(0).cast("long")))
    segments = F.transform(
        starts,
        lambda k: F.struct(
            k.cast("int").alias("segment_index"),
            F.round((k * length).cast("double"), 3).alias("start_seconds"),
            F.round(F.least(seconds, ((k + 1) * length).cast("double")), 3).alias("end_seconds"),
        ),
    )
    plan = F.struct(length.alias("chunk_seconds"), budget.alias("frame_budget"), (length > wanted).alias("stretched"), (length > limit).alias("loses_frames"), segments.alias("segments"))
    return F.when(seconds > 0, plan)


def clock(seconds: Column) -> Column:
    """``m:ss``, or ``h:mm:ss`` from one hour on."""
    whole = F.greatest(F.floor(finite(seconds)), F.lit(0)).cast("long")
    hours, minutes, rest = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    return F.when(whole >= 3600, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%d:%02d", minutes, rest))


def byte_size(size: Column) -> Column:
    """Bytes in the largest unit that gives at least 1, with one digit."""
    out = F.format_string("%d B", size)
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = F.when(size >= 1024**power, F.concat(F.round(size / 1024**power, 1).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def stamped(url: Column, seconds: Column, bare_site: str = "bilibili") -> Column:
    """The address with the position as its ``t`` parameter; an empty string for other schemes than http."""
    at = F.greatest(F.floor(finite(seconds)), F.lit(0)).cast("long").cast("string")
    value = F.when(F.contains(F.regexp_extract(url, r"^https?://([^/?#]+)", 1), F.lit(bare_site)), at).otherwise(F.concat(at, F.lit("s")))
    body, tail = F.regexp_extract(url, r"^([^#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    kept = F.regexp_replace(F.regexp_replace(body, r"([?&])t=[^&]*&?", "$1"), r"[?&]$", "")
    joined = F.concat(kept, F.when(F.contains(kept, F.lit("?")), "&t=").otherwise("?t="), value, tail)
    return F.when(url.rlike(r"^https?://[^/?#]+"), joined).otherwise("")


def fitted(width: Column, height: Column, most_width: int = 1280, most_height: int = 720) -> Column:
    """Even size that fits into a box without being enlarged."""
    scale = F.least(F.lit(1.0), most_width / width, most_height / height)
    even = lambda x: F.greatest(F.lit(2), F.floor(F.floor(x * scale + 0.5) / 2) * 2).cast("int")
    return F.struct(even(width).alias("width"), even(height).alias("height"))


def storyboard(spec: Column) -> Column:
    """Levels of a storyboard: its parts are split at ``|``, the geometry of a level at ``#``."""
    levels = F.slice(F.split(spec, r"\|"), 2, 1000)
    field = lambda x, n: F.try_element_at(F.split(x, "#"), F.lit(n))
    return F.transform(
        levels,
        lambda x, k: F.struct(
            k.alias("level"),
            *[field(x, n).try_cast("int").alias(name) for n, name in ((1, "width"), (2, "height"), (3, "frames"), (4, "columns"), (5, "rows"), (6, "interval_ms"))],
            field(x, 7).alias("name"),
            field(x, 8).alias("signature"),
        ),
    )


def backoff_ms(attempts: Column, base: int = 5000, most: int = 300_000, steps: int = 6) -> Column:
    """Pause before the next attempt: doubles up to a number of steps, within a limit."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2), F.least(attempts, F.lit(steps)))).cast("long")
