"""Embedding behind an interface: vectors from a table, or feature hashing of words (not a trained model)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.config import DEFAULT


class Embedder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed hashing of all lower-case words, unit length; the same text gives the same vector everywhere."""

    def __init__(self, dim: int = DEFAULT.embedding_dim):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for k, text in enumerate(texts):
            for word in "".join(c if c.isascii() and c.isalnum() else " " for c in (text or "").lower()).split():
                h = zlib.crc32(word.encode())
                out[k, h % self.dim] += 1 if h >> 31 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def embed(df: DataFrame, embedder: Embedder, text: str = "text", into: str = "embedding") -> DataFrame:
    """Add vectors; the embedder goes to each worker once and sees whole batches."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = embedder.encode(["" if t is None else t for t in texts])
            if found.shape != (len(texts), embedder.dim):
                raise ValueError(f"vectors have shape {found.shape}, not {(len(texts), embedder.dim)}")
            yield pd.Series(list(found))

    return df.withColumn(into, vectors(text))


def attach(df: DataFrame, vectors: DataFrame, key: str, vector_key: str) -> DataFrame:
    """Precomputed vectors by key."""
    return df.join(vectors.select(F.col(vector_key).alias(key), "embedding"), key)
