"""Embedding providers and the Arrow function that runs one over a column."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import Protocol
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Texts of one call of a provider.
BATCH = 100


class EmbeddingProvider(Protocol):
    """Text to vectors. ``count_tokens`` may be missing; then nothing is ever too long. With ``embed_batch`` texts go by the batch."""

    dimensions: int
    max_context: int

    def embed(self, text: str) -> list[float]: ...


class HashingEmbedder:
    """Deterministic bag-of-parts embedder: identifiers are cut at case changes and hashed with a sign."""

    _part = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

    def __init__(self, dimensions: int = 64, max_context: int = 2048) -> None:
        self.dimensions, self.max_context = dimensions, max_context

    def embed(self, text: str) -> list[float]:
        v = [0.0] * self.dimensions
        for w in self._part.findall(text or ""):
            h = crc32(w.lower().rstrip("s").encode() or b"s")
            v[h % self.dimensions] += 1.0 if h >> 31 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v

    def count_tokens(self, text: str) -> int:
        return len(re.findall(r"\w+|[^\w\s]", text or ""))


def embed_column(provider: EmbeddingProvider, text: Column) -> Column:
    """Vectors of a text column; the provider is set up once a task. Null texts give null."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        many = getattr(provider, "embed_batch", None) or (lambda texts: [provider.embed(t) for t in texts])
        for s in batches:
            out: list = [None] * len(s)
            held = [i for i, t in enumerate(s) if t is not None]
            for at in range(0, len(held), BATCH):
                for i, v in zip(held[at : at + BATCH], many([s.iloc[i] for i in held[at : at + BATCH]])):
                    out[i] = v
            yield pd.Series(out, index=s.index, dtype="object")

    return run(text)


def embed_documents(docs: DataFrame, provider: EmbeddingProvider, text: str = "content") -> DataFrame:
    return docs.withColumn("embedding", embed_column(provider, F.col(text)))
