"""Files on disk against rows in the index: reconciliation, coverage, pruning, partners, roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.functions.paths import SIDECARS, ancestors, extension, folder, stem


def scan_states(files: DataFrame, held_rows: DataFrame) -> DataFrame:
    """(root, path, state) with state pending, skipped or vanished.

    ``files`` has (root, path, fingerprint), one row per file; ``held_rows`` has (root, path, fingerprint, current), one row
    per chunk. A file is skipped only if all its rows are current and one of them has its fingerprint.
    """
    known = held_rows.groupBy("root", "path").agg(
        F.collect_set("fingerprint").alias("known"), F.min(F.coalesce("current", F.lit(False))).alias("all_current")
    )
    state = (
        F.when(F.col("fingerprint").isNull(), "vanished")
        .when(F.col("known").isNull() | ~F.col("all_current") | ~F.array_contains("known", F.col("fingerprint")), "pending")
        .otherwise("skipped")
    )
    return files.select("root", "path", "fingerprint").join(known, ["root", "path"], "full_outer").select("root", "path", state.alias("state"))


def input_current(kind: Column, version: Column, expected: Column, chunk_version: Column, expected_chunk: Column) -> Column:
    """Whether a row was made from the input form that is in use now."""
    blank = F.coalesce(version, F.lit("")) == ""
    return (
        F.when(~kind.isin("video", "image", "document"), False)
        .when(blank, kind != "document")
        .when(version != expected, False)
        .when(kind == "document", F.coalesce(chunk_version, F.lit("")) == expected_chunk)
        .otherwise(True)
    )


def coverage(files: DataFrame, held_rows: DataFrame) -> DataFrame:
    """(root, kind, path, state) with state cached, pending, stale or missing.

    ``files`` has (root, path, kind, fingerprint); ``held_rows`` (root, path, fingerprint, current, written) of which the last
    row of a path counts.
    """
    last = held_rows.groupBy("root", "path").agg(F.max_by(F.struct("fingerprint", "current"), "written").alias("last"))
    state = (
        F.when(F.col("fingerprint").isNull(), "missing")
        .when(F.col("last").isNull(), "pending")
        .when((F.col("last.fingerprint") == F.col("fingerprint")) & F.coalesce("last.current", F.lit(False)), "cached")
        .otherwise("stale")
    )
    return files.select("root", "path", "kind", "fingerprint").join(last, ["root", "path"], "full_outer").select("root", "kind", "path", state.alias("state"))


def coverage_totals(states: DataFrame) -> DataFrame:
    """Counts of the states per root and kind with totals per root and over all; ``level`` 0 is the finest."""
    counts = [F.count_if(F.col("state") == s).alias(s) for s in ("cached", "pending", "stale", "missing")]
    known = states.withColumns({"root": F.coalesce("root", F.lit("")), "kind": F.coalesce("kind", F.lit(""))})
    return known.rollup("root", "kind").agg(*counts, F.grouping_id().cast("int").alias("level"))


def missing_rows(held_rows: DataFrame, files: DataFrame) -> DataFrame:
    """Index rows whose file is gone."""
    return held_rows.join(files.select("path").distinct(), "path", "left_anti")


def missing_by_file(held_rows: DataFrame, files: DataFrame) -> DataFrame:
    """Gone files with the number of their rows, most first."""
    return missing_rows(held_rows, files).groupBy("path").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "path")


def sidecars(files: DataFrame, partners: DataFrame) -> DataFrame:
    """(path, partner, steps): for each file the text file of the same stem that is nearest.

    Files and partners have (path). The fewest steps between both folders count first, then the name. A folder on the way
    from a file to its partner lies above both, so partners are offered to all folders above them, and of each stem a
    folder keeps the two that are nearest to it (a file is no partner of itself). Files meet them by stem and folder, so a
    stem that thousands of files share costs a file no more than the folders above it.
    """
    left = files.select("path", stem(F.col("path")).alias("stem"), folder(F.col("path")).alias("folder")).distinct()
    right = (
        partners.select(F.col("path").alias("partner"))
        .where(extension(F.col("partner")).isin(*SIDECARS))
        .select("partner", stem(F.col("partner")).alias("stem"), folder(F.col("partner")).alias("folder"))
        .distinct()
    )
    # every folder above a folder, with the steps up to it
    parts = F.split("folder", "/")
    depth = F.size(parts)
    above = F.explode(F.transform(F.sequence(F.lit(0), depth), lambda n: F.struct(F.concat_ws("/", F.slice(parts, 1, n)).alias("folder"), n.alias("depth"), (depth - n).alias("up"))))
    # a folder "" of depth 1 and the start of depth 0 are two places, so the depth is part of the key
    offers = right.select("stem", "partner", above.alias("at")).select("stem", "partner", "at.*")
    place = F.row_number().over(W.partitionBy("stem", "folder", "depth").orderBy("up", "partner"))
    nearest = offers.withColumn("place", place).where("place <= 2").select("stem", "folder", "depth", "partner", F.col("up").alias("down"))
    asked = left.select("path", "stem", above.alias("at")).select("path", "stem", "at.*")
    rank = F.struct((F.col("up") + F.col("down")).alias("steps"), F.col("partner").alias("partner"))
    return asked.join(nearest, ["stem", "folder", "depth"]).where("path <> partner").groupBy("path").agg(F.min(rank).alias("best")).select("path", F.col("best.partner").alias("partner"), F.col("best.steps").alias("steps"))


def stems(files: DataFrame) -> DataFrame:
    """(stem, folder) with the files of that name in that folder counted, and the first by name."""
    return files.select(stem(F.col("path")).alias("stem"), folder(F.col("path")).alias("folder"), "path").distinct().groupBy("stem", "folder").agg(F.count("*").alias("files"), F.min("path").alias("first_path"))


def owning_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Each file with the deepest root above it, or null.

    A file is joined by equality with each folder above it, so there is no join by prefix; the match with the most
    characters is kept by aggregation.
    """
    above = files.select("path").distinct().select("path", F.explode(ancestors(F.col("path"))).alias("root"))
    known = roots.select("root").distinct().withColumn("found", F.col("root"))
    return above.join(known, "root", "left").groupBy("path").agg(F.max_by("found", F.length("found")).alias("owner"))


def overlapping_roots(roots: DataFrame) -> DataFrame:
    """(inner, outer): roots that lie below another one, by the same equality join."""
    above = roots.select(F.col("root").alias("inner_root"), F.explode(ancestors(F.col("root"))).alias("root"))
    return above.where("inner_root <> root").join(roots.select("root").distinct(), "root").select("inner_root", F.col("root").alias("outer_root")).distinct()


def scan_budget(pending: DataFrame, most: int) -> DataFrame:
    """The first files by path that one scan takes on."""
    return pending.orderBy("path").limit(most)


def stale_keys(old: DataFrame, fresh: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Old keys of files that were written again and whose key is not among the fresh ones.

    ``taken`` has (path) of all files that were read again, as those without chunks now have no fresh row.
    """
    rewritten = (fresh if taken is None else taken).select("path").distinct()
    return old.join(rewritten, "path", "left_semi").join(fresh.select("key").distinct(), "key", "left_anti").select("path", "key")


def last_versions(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("_at", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_at = 1").drop("_at")
