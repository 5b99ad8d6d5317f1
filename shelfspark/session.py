"""Session defaults and the shared working folder."""

from __future__ import annotations

import importlib.util
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def get_spark(app: str = "shelfspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects: UTC, adaptive execution, Arrow transfer."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The folder every executor shares, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) is a temporary folder made and set.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors of {spark.sparkContext.master} share")
        named = "file://" + tempfile.mkdtemp(prefix="shelfspark-")
        spark.conf.set(CHECKPOINT_KEY, named)
    return named


_made: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    _made.append(os.path.join(work_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}"))
    return _made[-1]


def clear_work(spark: SparkSession) -> None:
    """Delete what this process wrote below the shared folder. Results that have not been written are lost."""
    while _made:
        where = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_importable: set[str] = set()


def ensure_importable(spark: SparkSession) -> None:
    """Send the package to the Python workers if they cannot import it, as where only the driver's path names it.

    Looked at once per application, in one small task.
    """
    context = spark.sparkContext
    if context.applicationId in _importable:
        return

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("shelfspark") is not None] * batch.num_rows)], names=["found"])

    if not spark.range(1).mapInArrow(look, "found boolean").first()[0]:
        root = Path(__file__).parent.parent
        context.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "shelfspark"), "zip", root, "shelfspark"))
    _importable.add(context.applicationId)


def as_table(df: DataFrame, name: str, partition_by: list[str] | None = None, **options: int) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: lineage ends there and a lost executor loses nothing."""
    path = fresh_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists").options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
