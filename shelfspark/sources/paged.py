"""A vector service that answers in pages, as a Spark data source.

Subclass :class:`PagedVectors` with a ``connect`` that gives a client with ``shards(index)``, ``page(index, shard, token,
size)`` -> (rows, next token or None), ``put(index, rows)`` and ``delete(index, keys)``, then register the subclass with
``spark.dataSource.register``. Each shard is read by one task, page by page; writes go out in batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import batched
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

PAGE, MOST_PAGE, WRITE_BATCH = 500, 1000, 500


class Shard(InputPartition):
    """One shard of an index."""


@dataclass
class Written(WriterCommitMessage):
    rows: int


class PagedReader(DataSourceReader):
    def __init__(self, connect: Callable[[], Any], options: dict[str, str]) -> None:
        self.connect, self.index = connect, options["index"]
        self.size = max(1, min(MOST_PAGE, int(options.get("page_size", PAGE))))

    def partitions(self) -> list[Shard]:
        return [Shard(s) for s in self.connect().shards(self.index)]

    def read(self, partition: Shard) -> Iterator[tuple]:
        client, token = self.connect(), None
        while True:
            rows, token = client.page(self.index, partition.value, token, self.size)
            yield from rows
            if token is None:
                return


class PagedWriter(DataSourceWriter):
    def __init__(self, connect: Callable[[], Any], options: dict[str, str]) -> None:
        self.connect, self.index, self.mode = connect, options["index"], options.get("operation", "put")

    def write(self, rows: Iterator[Any]) -> Written:
        client, sent = self.connect(), 0
        for batch in batched(rows, WRITE_BATCH):
            if self.mode == "delete":
                client.delete(self.index, [r.key for r in batch])
            else:
                client.put(self.index, [tuple(r) for r in batch])
            sent += len(batch)
        return Written(sent)


class PagedVectors(DataSource):
    """Option ``index`` names the index, ``page_size`` the rows of a page (1 to 1000), ``operation`` put or delete."""

    @classmethod
    def name(cls) -> str:
        return "paged_vectors"

    @staticmethod
    def connect() -> Any:
        raise NotImplementedError("subclass PagedVectors with a connect() of your own")

    def schema(self) -> str:
        return "key string, vector array<float>, metadata map<string,string>"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.connect, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> PagedWriter:
        return PagedWriter(self.connect, self.options)
