"""Pluggable functions: embedders, rerankers and document readers, with defaults that need no network."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    """Texts to vectors of one dimension."""

    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Unit vectors from hashed words: the same text has the same vector everywhere, texts that share words are alike."""

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
                number = int.from_bytes(digest, "big")
                row[number % self.dimension] += 1 if number >> 63 else -1
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, lengths, out=np.zeros_like(out), where=lengths > 0)


class UnitEmbedder:
    """The first unit vector for any text."""

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        out[:, 0] = 1.0
        return out


def embedding(embedder: Embedder) -> Callable[[Column], Column]:
    """A column function text -> vector in Arrow batches; null for texts that are null or give no finite vector."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            known = texts.notna().to_numpy()
            vectors = embedder.embed(texts[known].tolist())
            if vectors.shape != (int(known.sum()), embedder.dimension):
                raise ValueError(f"{vectors.shape} vectors for {int(known.sum())} texts of dimension {embedder.dimension}")
            fine = iter([v.astype(np.float32) if np.isfinite(v).all() and v.any() else None for v in vectors])
            yield pd.Series([next(fine) if k else None for k in known], index=texts.index, dtype=object)

    return run


def reranked_by(score: Callable[[list[str], list[str]], list[float]], hits: DataFrame, query: str, text: str, position: str, candidates: int = 20) -> DataFrame:
    """(position, relevance) of the first candidates by a pluggable scorer; where it fails, no row, so that the old order stays."""

    @F.pandas_udf(T.DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        try:
            return pd.Series(score([query] * len(texts), texts.fillna("").tolist()), index=texts.index, dtype=float)
        except Exception:  # noqa: BLE001 - a scorer that is down must not fail the search
            return pd.Series([None] * len(texts), index=texts.index, dtype=float)

    head = hits.where(F.col(position) < candidates)
    return head.select(F.col(position).alias("position"), run(F.coalesce(text, F.lit(""))).alias("relevance")).where("relevance is not null and not isnan(relevance)")


def read_documents(files: DataFrame, readers: dict[str, Callable[[bytes], str]]) -> DataFrame:
    """(path, text, problem) of binary files (path, content) by plugged-in readers per extension."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                reader = readers.get(path.rsplit(".", 1)[-1].lower())
                try:
                    text = reader(content) if reader else None
                    rows.append((path, text or None, None if text else "no reader" if reader is None else "empty"))
                except Exception as error:  # noqa: BLE001 - one broken file must not fail the scan
                    rows.append((path, None, str(error)[:200]))
            yield pd.DataFrame(rows, columns=["path", "text", "problem"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, problem string")
