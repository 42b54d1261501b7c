"""Canonical schemas and settings."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import types as T

from sdlweave.sdl.documents import DOCUMENT

DOCUMENTS = T.StructType([*DOCUMENT.fields, T.StructField("collection", T.StringType())])
STORED = T.StructType([*DOCUMENTS.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
META = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])


@dataclass(frozen=True)
class EngineConfig:
    """Settings with their defaults; options given to a call win over these."""

    min_similarity: float = 0.4
    max_documents: int = 50
    max_retries: int = 5
    max_type_depth: int = 5
    category_limit: int = 500
    temperature: float = 0.2
    top_k: int = 40
    top_p: float = 0.9
    max_tokens: int = 2048
    batch_size: int = 100
    lists: int = 100
    probes: int = 10
    extract_terms: bool = False

    def with_options(self, **options) -> EngineConfig:
        """A copy with the options that are not None."""
        known = {f.name for f in fields(self)}
        if unknown := set(options) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return EngineConfig(**{f.name: options[f.name] if options.get(f.name) is not None else getattr(self, f.name) for f in fields(self)})
