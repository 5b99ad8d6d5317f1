"""A vector store over Parquet: one table, partitioned by index and embedding space.

Every read names the space it belongs to; a caller's filter is added to that and cannot replace it. Writes replace whole
partitions: the old and the new rows are merged by key, the newest stays. A write is staged beside the table and then
swapped in, so a lost executor or a failed job leaves the table as it was.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.functions.vectors import usable
from shelfspark.session import fresh_path

SCHEMA = "key string, vector array<float>, metadata map<string,string>, written_ms long, index_name string, space string"
#: Files that scans took in, also those without chunks: whether there was a text, its chunks, how many of them are stored, and how often it was tried.
FILES = "root string, path string, fingerprint string, has_text boolean, chunks long, vectors long, tries int, index_name string, space string"


def metadata_filter(values: dict[str, object], field: str = "metadata") -> Column | None:
    """Equality of all given fields as one condition; blank values are dropped. Missing fields count as empty strings."""
    pairs = {k: str(v).strip() for k, v in values.items() if v is not None and str(v).strip()}
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(f"{field}.{k}").cast("string"), F.lit("")) == v for k, v in pairs.items()]) if pairs else None


def scan(rows: DataFrame, space: Column, wanted_space: str, condition: Column | None = None) -> DataFrame:
    """Rows of one space that meet a condition."""
    own = rows.where(space == wanted_space)
    return own if condition is None else own.where(condition)


def lookup(rows: DataFrame, key: str, wanted: DataFrame, order: str) -> DataFrame:
    """Rows of the wanted keys with the position at which each key was first asked for; missing keys are left out."""
    asked = wanted.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.min(order).alias("asked_at"))
    return rows.join(asked, key)


class VectorStore:
    """Upsert, delete, scan and search of one table below a folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or fresh_path(spark, "store")

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def read(self, index: str, space: str, condition: Column | None = None) -> DataFrame:
        """Rows of one index and space; an index that was never written is empty."""
        table = self.spark.read.schema(SCHEMA).parquet(self.path) if self._exists(self.path) else self.spark.createDataFrame([], SCHEMA)
        own = table.where((F.col("index_name") == index) & (F.col("space") == space))
        return own if condition is None else own.where(condition)

    @property
    def files_path(self) -> str:
        """Below the table, where readers of the table pass it by."""
        return f"{self.path}/_files"

    def files(self, index: str, space: str) -> DataFrame:
        """Files that scans took in for one index and space."""
        table = self.spark.read.schema(FILES).parquet(self.files_path) if self._exists(self.files_path) else self.spark.createDataFrame([], FILES)
        return table.where((F.col("index_name") == index) & (F.col("space") == space)).drop("index_name", "space")

    def replace_files(self, index: str, space: str, rows: DataFrame) -> None:
        """Write the files that scans took in."""
        self._replace(index, space, rows, self.files_path)

    def dimension(self, index: str, space: str) -> int | None:
        found = self.read(index, space).select(F.size("vector")).first()
        return found[0] if found else None

    def upsert(self, index: str, space: str, rows: DataFrame) -> int:
        """Write (key, vector, metadata, written_ms); returns the number of rows. Nothing is written if any row is not valid."""
        known = self.dimension(index, space)
        shape = rows.agg(
            F.count("*").alias("n"),
            F.min(F.size("vector")).alias("low"),
            F.max(F.size("vector")).alias("high"),
            F.count_if(F.col("key").isNull() | (F.col("key") == "")).alias("blank"),
            F.count_if(F.col("vector").isNull() | F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).alias("bad"),
        ).first()
        if not shape.n:
            return 0
        if shape.blank or shape.bad or shape.low != shape.high or known not in (None, shape.low):
            raise ValueError(f"{shape.blank} blank keys, {shape.bad} bad vectors, dimensions {shape.low} to {shape.high}, the index has {known}")
        new = rows.select("key", "vector", "metadata", "written_ms").withColumn("_new", F.lit(1))
        old = self.read(index, space).select("key", "vector", "metadata", "written_ms").withColumn("_new", F.lit(0))
        newest = W.partitionBy("key").orderBy(F.desc("_new"), F.desc("written_ms"))
        self._replace(index, space, old.unionByName(new).withColumn("_at", F.row_number().over(newest)).where("_at = 1").drop("_at", "_new"))
        return shape.n

    def delete(self, index: str, space: str, keys: DataFrame) -> int:
        """Delete the given keys of one space; returns how many rows went."""
        own = self.read(index, space)
        gone = own.join(keys.select("key").distinct(), "key", "left_semi").count()
        if gone:
            self._replace(index, space, own.join(keys.select("key").distinct(), "key", "left_anti").select("key", "vector", "metadata", "written_ms"))
        return gone

    def purge(self, index: str, space: str, condition: Column) -> int:
        """Delete the rows of one space that meet a condition; rows for which it is null stay."""
        return self.delete(index, space, self.read(index, space, condition).select("key"))

    def patch(self, index: str, space: str, condition: Column, values: dict[str, str], now_ms: int) -> int:
        """Set metadata fields of the rows that meet a condition, vectors untouched; returns how many there are."""
        meets = F.coalesce(condition, F.lit(False))
        own = self.read(index, space)
        count = own.where(meets).count()
        if count:
            new = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
            kept = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*values))
            self._replace(
                index,
                space,
                own.select(
                    "key",
                    "vector",
                    F.when(meets, F.map_concat(kept, new)).otherwise(F.col("metadata")).alias("metadata"),
                    F.when(meets, F.lit(now_ms)).otherwise(F.col("written_ms")).cast("long").alias("written_ms"),
                ),
            )
        return count

    def search(self, index: str, space: str, query: list[float], limit: int, condition: Column | None = None) -> DataFrame:
        """The most similar rows that meet a condition."""
        from shelfspark.operators.search import top_k

        return top_k(self.read(index, space, condition), "vector", query, "key", limit)

    def counts(self) -> DataFrame:
        """Rows per index and space."""
        table = self.spark.read.schema(SCHEMA).parquet(self.path) if self._exists(self.path) else self.spark.createDataFrame([], SCHEMA)
        return table.groupBy("index_name", "space").count()

    def _replace(self, index: str, space: str, rows: DataFrame, path: str | None = None) -> None:
        path = path or self.path
        staged = fresh_path(self.spark, "staged")
        rows.write.parquet(staged)
        kept = self.spark.read.schema(rows.schema).parquet(staged)
        if kept.isEmpty():
            # an overwrite without rows would leave the partition as it was
            escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/index_name={escape(index)}/space={escape(space)}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
            return
        (
            kept.withColumns({"index_name": F.lit(index), "space": F.lit(space)})
            .write.partitionBy("index_name", "space")
            .option("partitionOverwriteMode", "dynamic")
            .mode("overwrite")
            .parquet(path)
        )


def valid(vector: Column, dimension: int) -> Column:
    """Whether a vector may be stored and found by cosine."""
    return usable(vector, dimension)
