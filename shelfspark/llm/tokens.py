"""Token counts of texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary splits a text before merging bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


_shipped: set[tuple[str, str]] = set()


def ship(spark: SparkSession, vocabulary: str) -> None:
    """Send the vocabulary, a file of the driver, to all executors, once per application."""
    key = spark.sparkContext.applicationId, vocabulary
    if key not in _shipped:
        spark.sparkContext.addFile(vocabulary)
        _shipped.add(key)


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str):  # noqa: ANN201
    """The encoding, loaded once per Python worker from the file that was sent."""
    import tiktoken

    with open(SparkFiles.get(os.path.basename(vocabulary)), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return tiktoken.Encoding(os.path.basename(vocabulary), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counter(vocabulary: str = VOCABULARY) -> Callable:
    """A column function: text -> number of tokens; null counts 0. The vocabulary must have been sent by :func:`ship`."""

    @F.pandas_udf(T.LongType())
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(vocabulary)
        for texts in parts:
            yield pd.Series(np.fromiter((len(encode.encode_ordinary(t)) if t else 0 for t in texts), np.int64, len(texts)))

    return count
