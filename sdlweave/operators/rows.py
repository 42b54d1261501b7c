"""Relational steps over document rows: dedup, diff, upsert, routing, grouping and chat turns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row a key, the last in ``order``: what a sequence of upserts leaves. Null keys are one key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[(F.col(o) if isinstance(o, str) else o).desc() for o in order]))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def added(new: DataFrame, old: DataFrame, key: str = "id") -> DataFrame:
    return new.join(old.select(key), key, "left_anti")


def removed(new: DataFrame, old: DataFrame, key: str = "id") -> DataFrame:
    return old.join(new.select(key), key, "left_anti")


def unchanged(new: DataFrame, old: DataFrame, key: str = "id") -> DataFrame:
    return new.join(old.select(key), key, "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: Sequence[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` replaced or added; of repeated keys in ``new`` the last in ``order`` stays."""
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, [key], ["_src", *order]).drop("_src")


def delete_by_keys(df: DataFrame, keys: DataFrame, key: str | Sequence[str] = "id") -> DataFrame:
    """Rows whose key is not among ``keys``; null keys match nothing and stay."""
    names = [key] if isinstance(key, str) else list(key)
    return df.join(keys.select(*names), names, "left_anti")


def group_fields(df: DataFrame, parent: Column, order: str, text: str, keys: Sequence[str] = ()) -> DataFrame:
    """``*keys, parent, n, body``: the texts of each parent in order; rows without a parent go to Unknown."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(*keys, F.coalesce(parent, F.lit("Unknown")).alias("parent")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(items, lambda x: x["t"]), "\n").alias("body"))


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """Chunk rows of a type put together again: first header, then all bodies in order, with ``complete``.

    Grouped by collection, type and name; a chunk index that occurs twice counts once (the smallest id).
    """
    once = keep_first(chunks.withColumns({"_i": F.col("metadata.chunkIndex"), "_t": F.col("metadata.totalChunks")}).filter(F.col("_i").isNotNull()), ["collection", "type", "name", "_i"], ["id"])
    header = F.regexp_extract("content", r'\A((?:"""[\s\S]*?"""|"(?:\\.|[^"\\])*"|[^{"])*\{)', 1)
    body = F.expr("substring(content, length(_h) + 1, length(content) - length(_h) - 1)")
    parts = F.array_sort(F.collect_list(F.struct("_i", "_h", "_b")))
    merged = once.withColumn("_h", header).withColumn("_b", body).groupBy("collection", "type", "name").agg(parts.alias("p"), F.max("_t").alias("total"), F.count(F.lit(1)).alias("n_chunks"))
    return merged.select("collection", "type", "name", F.concat(F.col("p")[0]["_h"], F.array_join(F.transform("p", lambda x: x["_b"]), ""), F.lit("}")).alias("content"), "n_chunks", (F.col("n_chunks") == F.col("total")).alias("complete"))


def route(df: DataFrame, tokens: Column, max_tokens: int = 2048, text: str = "content") -> DataFrame:
    """``tokens, safe_chars, route``: rows within the budget embed, others chunk to ``safe_chars`` characters.

    ``safe_chars = floor(max_tokens * length / tokens * 0.9)``.
    """
    t = df.withColumn("tokens", tokens)
    safe = F.floor(F.lit(max_tokens) * F.try_divide(F.length(text).cast("double"), F.col("tokens").cast("double")) * 0.9).cast("int")
    return t.withColumn("safe_chars", safe).withColumn("route", F.when(F.col("tokens") <= max_tokens, "embed").otherwise("chunk"))


def settle(chunks: DataFrame, max_tokens: int = 2048, source: str = "source_id") -> DataFrame:
    """``status`` of each row after chunking: embedded, chunked, or skipped if a source gave one chunk or any too long."""
    w = Window.partitionBy(source)
    n, longest = F.count(F.lit(1)).over(w), F.max("tokens").over(w)
    return chunks.withColumn("status", F.when(F.col("route") == "embed", "embedded").when((n > 1) & (longest <= max_tokens), "chunked").otherwise("skipped"))


def merge_turns(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", joiner: str = "\n\n") -> DataFrame:
    """Consecutive turns of one role as one: ``conversation, island, role, text, first_turn``."""
    w = Window.partitionBy(conversation).orderBy(turn)
    flag = F.when(F.lag(role).over(w).eqNullSafe(F.col(role)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    island = turns.withColumn("_new", flag).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), joiner)
    return island.groupBy(conversation, "island", role).agg(body.alias("text"), F.min(turn).alias("first_turn"))


def fold_system(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """All system turns of a conversation as one text."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), "\n\n")
    return turns.filter(F.col(role) == "system").groupBy(conversation).agg(body.alias("system"))


def pad_first_user(merged: DataFrame, conversation: str = "conv_id", filler: str = "Continue.") -> DataFrame:
    """A user turn before conversations that begin with another role."""
    first = keep_first(merged, [conversation], ["first_turn"]).filter(F.col("role") != "user")
    pad = first.select(conversation, (F.col("island") - 1).alias("island"), F.lit("user").alias("role"), F.lit(filler).alias("text"), (F.col("first_turn") - 1).alias("first_turn"))
    return merged.unionByName(pad)
