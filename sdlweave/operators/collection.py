"""Collections of vectors on Parquet: rows in buckets by key, versions named by numbered manifests.

A change writes the buckets it touches beside the old ones and then a manifest with the next number; the manifest is
written whole under another name and renamed, which fails if the number is taken. So a reader sees one version or the
other, a failed write leaves the old one, and a second writer at the same time gets an error instead of losing an update.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sdlweave.operators import ivf, rows, search
from sdlweave.operators.predicates import ColumnFilter, MetadataFilter
from sdlweave.runtime import stage
from sdlweave.schema import META, STORED

_TABLE = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")
SDL_KEY = "schema_sdl"
#: Buckets of a collection. A change rewrites those that hold its keys: raise it with the collection.
BUCKETS = 16
#: The row that stands for the schema text in stores that hold vectors only, and its near-zero value. Fixed values.
SENTINEL_ID, NEAR_ZERO = "__schema_sdl__", 1e-7
_LAYOUT = T.StructType([*STORED.fields, T.StructField("cell", T.IntegerType())])


class ConcurrentChange(RuntimeError):
    """Another writer has changed the collection meanwhile; nothing was changed by this call."""


class _Files:
    """Paths of any Hadoop file system, through the session's JVM."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.jvm = spark, spark._jvm

    def _open(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._open(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._open(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) and fs.getFileStatus(p).isDirectory() else []

    def read(self, path: str) -> str | None:
        fs, p = self._open(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(b & 0xFF for b in stream.readAllBytes()).decode()
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        fs, p = self._open(path)
        fs.delete(p, True)

    def publish(self, path: str, text: str) -> None:
        """The file appears whole, or not at all if there is one of that name."""
        fs, p = self._open(path)
        beside = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(context.makeQualified(beside), context.makeQualified(p), self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(beside, False)
            if fs.exists(p):
                raise ConcurrentChange(path) from e
            raise


class VectorCollection:
    """One named collection under ``root``."""

    def __init__(self, spark: SparkSession, root: str, name: str = "embeddings", buckets: int = BUCKETS) -> None:
        if not _TABLE.fullmatch(name):
            raise ValueError(f"not a table name: {name!r}")
        self.spark, self.name, self.base, self.buckets = spark, name, f"{root.rstrip('/')}/{name}", buckets
        self.files = _Files(spark)

    # -- storage --------------------------------------------------------------------------------
    def _versions(self) -> list[int]:
        return sorted(int(n[len("manifest-") :]) for n in self.files.names(self.base) if re.fullmatch(r"manifest-\d+", n))

    def _manifest(self) -> tuple[int, dict]:
        """Number and content: folders of the buckets, their number, the meta folder, and the index if there is one."""
        known = self._versions()
        if not known:
            return 0, {"buckets": {}, "count": self.buckets, "meta": None, "index": None}
        return known[-1], json.loads(self.files.read(f"{self.base}/manifest-{known[-1]:010}") or "{}")

    def _publish(self, number: int, manifest: dict) -> None:
        self.files.publish(f"{self.base}/manifest-{number + 1:010}", json.dumps(manifest))

    def _write(self, df: DataFrame, count: int) -> dict[str, str]:
        """Write the rows in buckets; the folder of each that is not empty."""
        folder = f"rows-{uuid.uuid4().hex}"
        placed = df.withColumn("bucket", self._bucket(count)).repartition(count, "bucket").sortWithinPartitions("bucket", "cell")
        placed.write.partitionBy("bucket").parquet(f"{self.base}/{folder}")
        return {n.split("=")[1]: f"{folder}/{n}" for n in self.files.names(f"{self.base}/{folder}") if n.startswith("bucket=")}

    @staticmethod
    def _bucket(count: int):
        return F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")

    def _stored(self, folders: Iterable[str]) -> DataFrame:
        paths = [f"{self.base}/{f}" for f in folders]
        return self.spark.read.schema(_LAYOUT).parquet(*paths) if paths else self.spark.createDataFrame([], _LAYOUT)

    def create(self) -> VectorCollection:
        """Make the collection if it does not exist."""
        number, manifest = self._manifest()
        if not number:
            self._publish(0, manifest)
        return self

    def read(self) -> DataFrame:
        return self._stored(self._manifest()[1]["buckets"].values()).drop("cell")

    def _change(self, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Rewrite the buckets of the ids in ``touched``; the others stay as they are."""
        number, manifest = self._manifest()
        count = manifest["count"]
        some = {str(r[0]) for r in touched.select(self._bucket(count)).distinct().collect()}  # at most a row a bucket
        if not some:
            return
        written = self._write(change(self._stored(f for b, f in manifest["buckets"].items() if b in some)), count)
        kept = {b: f for b, f in manifest["buckets"].items() if b not in some}
        self._publish(number, {**manifest, "buckets": {**kept, **written}})

    def _celled(self, df: DataFrame, manifest: dict) -> DataFrame:
        index = manifest["index"]
        if not index:
            return df.select(*[f.name for f in STORED.fields], F.lit(None).cast("int").alias("cell"))
        return ivf.assign(df.select(*[f.name for f in STORED.fields]), np.array(index["centroids"]))

    def upsert(self, new: DataFrame) -> None:
        """Rows replace those of the same id; of repeated ids the last ordinal stays. All or nothing."""
        shaped = new.select(*[F.col(f.name).cast(f.dataType) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in STORED.fields])
        shaped = stage(self._celled(shaped, self._manifest()[1]))  # read for its buckets and for its rows
        self._change(shaped, lambda old: rows.upsert(old, shaped, "id", ["ordinal"]))

    def delete(self, ids: Sequence[str] | DataFrame, key: str = "id") -> None:
        """No change on an empty list."""
        if not isinstance(ids, DataFrame):
            if not ids:
                return
            ids = self.spark.createDataFrame([(i,) for i in ids], f"{key} string")
        touched = ids if key == "id" else self.read().join(ids.select(key), key, "left_semi")
        self._change(touched.select("id"), lambda old: rows.delete_by_keys(old, ids, key))

    def clear(self) -> None:
        """No rows and no schema text."""
        number, manifest = self._manifest()
        self._publish(number, {**manifest, "buckets": {}, "meta": self._meta_folder(self._meta().filter(F.col("key") != SDL_KEY)), "index": None})

    def vacuum(self) -> int:
        """Delete what only older manifests name; no reader of an older version may be at work. Returns the number of folders."""
        known = self._versions()
        number, manifest = self._manifest()
        named = {f.split("/")[0] for f in manifest["buckets"].values()} | {manifest["meta"]}
        held = set(manifest["buckets"].values())
        old = [n for n in self.files.names(self.base) if n.startswith(("rows-", "meta-")) and n not in named]
        for n in named - {None}:
            old += [f"{n}/{b}" for b in self.files.names(f"{self.base}/{n}") if b.startswith("bucket=") and f"{n}/{b}" not in held]
        for n in [*old, *(f"manifest-{v:010}" for v in known if v != number)]:
            self.files.delete(f"{self.base}/{n}")
        return len(old)

    def build_index(self, lists: int = 100, target: float = 0.95) -> int:
        """Inverted lists over all rows; the probes at which a bounded sample reaches ``target`` recall, which are returned.

        Rows that are added later enter the nearest list; build it again when they are many.
        """
        number, manifest = self._manifest()
        old = self._stored(manifest["buckets"].values())
        centroids, probes = ivf.fit_calibrated(old, lists, target)
        found = {**manifest, "index": {"centroids": centroids.tolist(), "probes": probes}}
        self._publish(number, {**found, "buckets": self._write(self._celled(old, found), manifest["count"])})
        return probes

    # -- reading --------------------------------------------------------------------------------
    def count(self) -> int:
        return self.read().count()

    def search(self, query: Sequence[float], limit: int = search.DEFAULT_LIMIT, metadata: Iterable[MetadataFilter] = (), columns: Iterable[ColumnFilter] = (), probes: int | None = None) -> DataFrame:
        """The most similar rows. With an index and no filters only the nearest lists are read, ``probes`` of them or, by
        default, as many as were found to be needed; 0 reads all rows. With filters all rows that pass them are compared.
        """
        _, manifest = self._manifest()
        metadata, columns, index = list(metadata), list(columns), manifest["index"]
        if not index or probes == 0 or metadata or columns:
            return search.top_k(self.read(), query, limit, metadata, columns)
        return ivf.probe(self._stored(manifest["buckets"].values()), np.array(index["centroids"]), query, limit, probes or index["probes"]).drop("cell")

    def lookup(self, metadata: Iterable[MetadataFilter] = (), columns: Iterable[ColumnFilter] = (), limit: int | None = None) -> DataFrame:
        return search.lookup(self.read().drop("embedding"), metadata, columns, limit=limit)

    # -- the schema text ------------------------------------------------------------------------
    def _meta(self) -> DataFrame:
        folder = self._manifest()[1]["meta"]
        return self.spark.read.schema(META).parquet(f"{self.base}/{folder}") if folder else self.spark.createDataFrame([], META)

    def _meta_folder(self, df: DataFrame) -> str:
        folder = f"meta-{uuid.uuid4().hex}"
        df.coalesce(1).write.parquet(f"{self.base}/{folder}")
        return folder

    def store_sdl(self, sdl: str) -> None:
        number, manifest = self._manifest()
        self._publish(number, {**manifest, "meta": self._meta_folder(rows.upsert(self._meta(), self.spark.createDataFrame([(SDL_KEY, sdl)], META), "key"))})

    def sdl(self, *before: str | Callable[[], str | None] | None) -> str | None:
        """The schema text by a cascade: the first of ``before`` (texts, or functions that look one up) that gives one, then the stored one."""
        for source in before:
            text = source() if callable(source) else source
            if text:
                return text
        row = self._meta().filter(F.col("key") == SDL_KEY).first()
        return row["value"] if row else None


def collections(spark: SparkSession, root: str) -> list[str]:
    """Names of the collections under ``root``, sorted."""
    files = _Files(spark)
    return [n for n in files.names(root) if any(re.fullmatch(r"manifest-\d+", x) for x in files.names(f"{root.rstrip('/')}/{n}"))]


def filled_namespaces(df: DataFrame, namespace: str = "collection") -> DataFrame:
    """Namespaces that hold rows, with their counts."""
    return df.groupBy(namespace).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0)


def replace_entities(entities: DataFrame, path: str, designs: Iterable[str] | None = None) -> None:
    """The rows of ``designs`` (by default those in ``entities``) are replaced by ``entities``; other designs stay.

    A design that is named and has no rows is emptied.
    """
    spark, files = entities.sparkSession, _Files(entities.sparkSession)
    entities = stage(entities)
    if designs is not None:
        given = {r[0] for r in entities.select("design_id").distinct().join(spark.createDataFrame([(d,) for d in designs], "design_id string"), "design_id").collect()}  # at most the named ones
        for design in set(designs) - given:
            clear_entities(spark, path, design)
    if not entities.isEmpty() or not files.exists(path):
        entities.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("design_id").parquet(path)


def clear_entities(spark: SparkSession, path: str, design: str | None = None) -> None:
    """Drop the rows of one design, or of all."""
    files = _Files(spark)
    if design is None:
        for n in files.names(path):
            if n.startswith("design_id="):
                files.delete(f"{path}/{n}")
        return
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(design)
    files.delete(f"{path}/design_id={escaped}")


# -- stores that hold vectors only ---------------------------------------------------------------
def query_or_near_zero(query: Sequence[float]) -> list[float]:
    """Such stores reject a query of zeros; it is replaced by a near-zero one."""
    return list(query) if any(query) else [NEAR_ZERO] * len(query)


def sentinel(sdl: str, dimensions: int) -> dict:
    """The record that carries the schema text."""
    return {"id": SENTINEL_ID, "values": [NEAR_ZERO] * dimensions, "metadata": {"type": SDL_KEY, "content": sdl}}


def without_sentinel(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows that are documents; null keys stay."""
    return df.filter(~F.col(key).eqNullSafe(F.lit(SENTINEL_ID)))


def upsert_external(df: DataFrame, connect: Callable[[], Callable[[str, list[dict]], None]], namespace: str, size: int = 100) -> None:
    """Send ``id, values, metadata`` records to an external store in batches of ``size``.

    ``connect`` runs once a task and returns ``send(namespace, records)``. A task that runs again sends its records again,
    so the store must treat equal ids as replacements. Rows without a vector are left out.
    """

    def run(part: Iterator) -> None:
        send, batch = connect(), []
        for r in part:
            batch.append({"id": r["id"], "values": list(r["embedding"]), "metadata": {k: v for k, v in json.loads(r["m"]).items() if v is not None}})
            if len(batch) == size:
                send(namespace, batch)
                batch = []
        if batch:
            send(namespace, batch)

    kept = [c for c in ("type", "name", "description", "content", "metadata") if c in df.columns]
    df.filter("embedding is not null").select("id", "embedding", F.to_json(F.struct(*kept)).alias("m")).foreachPartition(run)
