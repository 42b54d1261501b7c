"""Scans of schema files, composed-schema configurations and documents, and the file sinks."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sdlweave.functions.text import is_schema_text


def sdl_files(spark: SparkSession, path: str, glob: str = "*.graphql*", recursive: bool = True) -> DataFrame:
    """``path, sdl`` of schema files (``.graphql``, ``.graphqls``); blank ones and dependency folders are left out."""
    raw = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True)
    found = raw.select(F.input_file_name().alias("path"), F.col("value").alias("sdl"))
    return found.filter((F.trim("sdl") != "") & ~F.col("path").contains("/node_modules/"))


def discover(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, modificationTime, length`` of all files below ``path``, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.drop("content").filter(~F.col("path").contains("/node_modules/"))


def schema_only(files: DataFrame, sdl: str = "sdl") -> DataFrame:
    """Files that define something of a schema."""
    return files.filter(is_schema_text(F.col(sdl)))


def not_owned(files: DataFrame, designs: DataFrame) -> DataFrame:
    """Schema files that no federated design refers to (by real path)."""
    owned = designs.filter(F.col("type") == "federated").select(F.explode("subgraphs").alias("s")).select(F.col("s.schema_path").alias("path")).filter("path is not null").distinct()
    return files.join(owned, "path", "left_anti")


_CONFIG = "path string, federation_version string, federation_version_line int, subgraphs array<struct<name:string,schema_path:string,routing_url:string>>, error string"


def read_config(path: str, text: str) -> dict:
    """One configuration: subgraphs with a schema file, the federation version and its line (from 1)."""
    import yaml

    row = {"path": path, "federation_version": None, "federation_version_line": None, "subgraphs": [], "error": None}
    try:
        top = yaml.safe_load(text)
        if not isinstance(top, dict):
            raise ValueError("not a mapping")
        for name, s in (top.get("subgraphs") or {}).items():
            schema = s.get("schema") if isinstance(s, dict) else None
            file = schema.get("file") if isinstance(schema, dict) else None
            if file:
                row["subgraphs"].append({"name": str(name), "schema_path": posixpath.normpath(posixpath.join(posixpath.dirname(path), str(file))), "routing_url": s.get("routing_url")})
        if top.get("federation_version") is not None:
            row["federation_version"] = str(top["federation_version"])
            row["federation_version_line"] = next((i for i, x in enumerate(text.splitlines(), 1) if x.lstrip().startswith("federation_version:")), None)
    except (yaml.YAMLError, ValueError, AttributeError) as e:
        row["error"] = str(e).splitlines()[0]
    return row


def configs(files: DataFrame, text: str = "value") -> DataFrame:
    """A row per configuration file; ones that cannot be read carry an error and no subgraphs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([("name", pa.string()), ("schema_path", pa.string()), ("routing_url", pa.string())])
        schema = pa.schema([("path", pa.string()), ("federation_version", pa.string()), ("federation_version_line", pa.int32()), ("subgraphs", pa.list_(struct)), ("error", pa.string())])
        for b in batches:
            yield pa.RecordBatch.from_pylist([read_config(p, t or "") for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], schema=schema)

    return files.select("path", text).mapInArrow(run, _CONFIG)


def write_sdl(df: DataFrame, path: str, name: str = "name", sdl: str = "sdl") -> None:
    """Each schema text as one file, in a folder ``name=...`` below ``path``; a name that is given again is replaced, others stay."""
    rows = df.select(F.col(name).alias("name"), F.col(sdl).alias("value"))
    rows.repartition("name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").text(path)


def listing(spark: SparkSession, folder: str, glob: str = "*.graphql*") -> DataFrame:
    """``path, modificationTime, length`` of the files below ``folder`` as they are now; empty if there are none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "modificationTime", "length")


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """``path, change`` (added, modified, deleted) between two listings."""
    b = before.select("path", F.struct("modificationTime", "length").alias("b"))
    n = now.select("path", F.struct("modificationTime", "length").alias("n"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col("b") != F.col("n"), "modified")
    return b.join(n, "path", "full").select("path", change.alias("change")).filter("change is not null")


def embedding_tables(spark: SparkSession, column: str = "embedding") -> list[str]:
    """Catalog tables of the current database with a vector column, sorted."""
    named = {t.name for t in spark.catalog.listTables() if not t.isTemporary}
    return sorted(n for n in named if any(c.name == column for c in spark.catalog.listColumns(n)))
