"""Embedding under a token budget, and incremental sync by content ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sdlweave.operators import rows
from sdlweave.operators.collection import VectorCollection
from sdlweave.operators.embedding import EmbeddingProvider, embed_documents
from sdlweave.runtime import stage
from sdlweave.sdl.documents import chunk_documents, documents, DOCUMENT
from sdlweave.sdl.lexer import SyntaxProblem


def tokens_of(provider: EmbeddingProvider, text: str):
    """Token counts by the provider; 0 (never too long) if it cannot count."""
    count = getattr(provider, "count_tokens", None)
    return F.udf(count, "int", useArrow=True)(F.col(text)) if count else F.lit(0)


def budgeted(docs: DataFrame, provider: EmbeddingProvider, max_tokens: int | None = None) -> DataFrame:
    """Rows after routing: ``status`` is embedded, chunked or skipped."""
    most = max_tokens or getattr(provider, "max_context", None) or 2048
    routed = rows.route(docs.withColumn("source_id", F.coalesce("source_id", "id")), tokens_of(provider, "content"), most)
    cut = chunk_documents(routed.withColumn("safe_chars", F.when(F.col("route") == "chunk", F.col("safe_chars"))), limit_column="safe_chars")
    counted = cut.withColumn("tokens", tokens_of(provider, "content"))
    return rows.settle(stage(counted), most)


def embed_and_store(docs: DataFrame, collection: VectorCollection, provider: EmbeddingProvider, max_tokens: int | None = None) -> DataFrame:
    """Embed what fits, chunk what does not, skip what cannot be chunked; store; return the report.

    The report counts ``embedded`` rows (not distinct ids), ``chunked`` and ``skipped`` source documents, and
    ``distinct_ids``; it also shows ``collisions``, ids shared by different contents.
    """
    settled = stage(budgeted(docs, provider, max_tokens))
    keep = settled.filter(F.col("status") != "skipped")
    collection.create().upsert(embed_documents(keep, provider))
    return settled.agg(
        F.count(F.when(F.col("status") != "skipped", 1)).alias("embedded"),
        F.countDistinct(F.when(F.col("status") == "chunked", F.col("source_id"))).alias("chunked"),
        F.countDistinct(F.when(F.col("status") == "skipped", F.col("source_id"))).alias("skipped"),
        F.countDistinct(F.when(F.col("status") != "skipped", F.col("id"))).alias("distinct_ids"),
        (F.countDistinct("id", "content") - F.countDistinct("id")).alias("collisions"),
    )


def document_frame(spark: SparkSession, sdl: str, collection: str) -> DataFrame:
    return spark.createDataFrame(documents(sdl), DOCUMENT).withColumn("collection", F.lit(collection))


def sync(spark: SparkSession, sdl: str, collection: VectorCollection, provider: EmbeddingProvider) -> dict[str, int]:
    """Bring the collection to ``sdl`` by id difference; ``added, deleted, unchanged, updated`` (always 0).

    Without a stored text, or with one that does not parse, everything is embedded again. Ids are those from
    before chunking, so all chunks of a deleted document go with it.
    """
    new = rows.keep_last(document_frame(spark, sdl, collection.name), ["id"], ["ordinal"])
    try:
        stored = collection.create().sdl()
        old = documents(stored) if stored else None
    except SyntaxProblem:
        old = None
    if old is None:
        collection.clear()
        embed_and_store(new, collection, provider)
        collection.store_sdl(sdl)
        return {"added": new.count(), "deleted": 0, "unchanged": 0, "updated": 0}
    before = spark.createDataFrame(old, DOCUMENT).select("id").distinct()
    add, gone, same = stage(rows.added(new, before)), stage(rows.removed(new, before)), rows.unchanged(new, before).count()
    if not gone.isEmpty():
        collection.delete(gone.withColumnRenamed("id", "source_id"), "source_id")
    if not add.isEmpty():
        embed_and_store(add, collection, provider)
    collection.store_sdl(sdl)
    return {"added": add.count(), "deleted": gone.count(), "unchanged": same, "updated": 0}


class EmbeddingService:
    """A provider and a collection as one: embed and store, search by text, delete, clear, count."""

    def __init__(self, collection: VectorCollection, provider: EmbeddingProvider) -> None:
        self.collection, self.provider = collection, provider

    def initialize(self) -> EmbeddingService:
        self.collection.create()
        return self

    def embed_and_store(self, docs: DataFrame, max_tokens: int | None = None) -> DataFrame:
        return embed_and_store(docs, self.collection, self.provider, max_tokens)

    def search(self, text: str, limit: int = 10, **filters) -> DataFrame:
        """``name, type, content, score`` of the most similar documents."""
        return self.collection.search(self.provider.embed(text), limit, **filters).select("id", "name", "type", "content", "score")

    def sync(self, sdl: str) -> dict[str, int]:
        return sync(self.collection.spark, sdl, self.collection, self.provider)

    def delete(self, ids: list[str]) -> None:
        self.collection.delete(ids)

    def clear(self) -> None:
        self.collection.clear()

    def count(self) -> int:
        return self.collection.count()
