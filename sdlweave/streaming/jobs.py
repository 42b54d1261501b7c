"""Incremental forms: bursts of changes, file sync, windows over events, and a stateful retry counter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sdlweave.operators.collection import VectorCollection, _Files
from sdlweave.operators.embedding import EmbeddingProvider
from sdlweave.operators.sync import sync
from sdlweave.runtime import stage
from sdlweave.sources.files import changes, listing


def bursts(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "300 milliseconds") -> DataFrame:
    """Runs of events of a key without a gap: one row a burst, as a debounce would fire. Batch or stream."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"), "n")


def tumbling(events: DataFrame, size: str = "1 hour", ts: str = "ts", by: str = "event_type") -> DataFrame:
    return events.groupBy(F.window(ts, size).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def sliding(events: DataFrame, size: str = "1 hour", slide: str = "30 minutes", ts: str = "ts", by: str = "event_type") -> DataFrame:
    return events.groupBy(F.window(ts, size, slide).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


_LISTED = "path string, modificationTime timestamp, length long"


def poll(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], state: str, glob: str = "*.graphql") -> int:
    """Compare the folder with the last listing kept under ``state`` and hand over what changed, if anything did.

    ``handle`` gets ``path, change, sdl, changed_at`` for added, modified and deleted files (without text) and the number of
    the listing. A listing counts once ``handle`` has returned, so a failed one is handed over again. Returns the number of changes.
    A file source would see each path once only; this also sees a file that is rewritten or removed.
    """
    files = _Files(spark)
    known = sorted(n for n in files.names(state) if n.startswith("listing-") and files.exists(f"{state}/{n}/_SUCCESS"))
    number = int(known[-1][len("listing-") :]) + 1 if known else 0
    now = stage(listing(spark, folder, glob))
    before = spark.read.schema(_LISTED).parquet(f"{state}/{known[-1]}") if known else spark.createDataFrame([], _LISTED)
    changed = stage(changes(before, now))
    n = changed.count()
    if n:
        texts = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("sdl"), F.col("_metadata.file_modification_time").alias("changed_at"))
        same = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
        texts = texts.withColumn("_p", same(F.col("path"))).drop("path")
        handle(changed.withColumn("_p", same(F.col("path"))).join(texts, "_p", "left").drop("_p"), number)
    now.write.mode("overwrite").parquet(f"{state}/listing-{number:010}")
    for old in known:
        files.delete(f"{state}/{old}")
    return n


def watch(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], state: str, glob: str = "*.graphql", every: str = "1 second"):
    """A running stream that polls the folder at each trigger."""
    beat = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return beat.writeStream.foreachBatch(lambda _, __: poll(spark, folder, handle, state, glob) and None).option("checkpointLocation", f"{state}/beat").trigger(processingTime=every).start()


def _keep_in_step(collection: VectorCollection, provider: EmbeddingProvider) -> Callable[[DataFrame, int], None]:
    def handle(df: DataFrame, _: int) -> None:
        last = df.filter("sdl is not null").orderBy(F.desc("changed_at"), "path").first()
        if last is not None:
            sync(df.sparkSession, last["sdl"], collection, provider)

    return handle


def sync_folder(spark: SparkSession, folder: str, collection: VectorCollection, provider: EmbeddingProvider, state: str) -> int:
    """Bring a collection in step with the schema file of a folder, if it has changed since the last call: the newest text counts."""
    return poll(spark, folder, _keep_in_step(collection, provider), state)


def sync_stream(spark: SparkSession, folder: str, collection: VectorCollection, provider: EmbeddingProvider, state: str, every: str = "1 second"):
    """The same as a running stream."""
    return watch(spark, folder, _keep_in_step(collection, provider), state, every=every)


def late_counts(events: DataFrame, delay: str = "10 minutes", size: str = "5 minutes", ts: str = "ts", by: str = "event_type") -> DataFrame:
    """Windowed counts of a stream under a watermark; later events are dropped."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(F.window(ts, size).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def retry_states(attempts: DataFrame, most: int = 5):
    """Per request, over a stream of ``request_id, error_key``: attempts so far, and whether the last error repeats."""

    def update(key, batches, state):
        count, last, stalled = state.get if state.exists else (0, "", False)
        for pdf in batches:
            for k in pdf["error_key"]:
                stalled, last, count = (k == last and k != ""), k, count + 1
        state.update((count, last, stalled))
        import pandas as pd

        yield pd.DataFrame({"request_id": [key[0]], "attempts": [count], "stalled": [stalled], "exhausted": [count >= most]})

    return attempts.groupBy("request_id").applyInPandasWithState(update, "request_id string, attempts int, stalled boolean, exhausted boolean", "count int, last string, stalled boolean", "update", "NoTimeout")
