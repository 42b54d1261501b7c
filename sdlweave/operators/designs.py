"""Designs, their files and tables, and the mapping of composition errors to places."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sdlweave.functions.text import table_name


def design_name(config_path: F.Column):
    """A design's name from its path: the folder of a composed one, the file's stem otherwise."""
    folder = F.regexp_extract(config_path, r"([^/]+)/supergraph\.ya?ml$", 1)
    stem = F.regexp_extract(config_path, r"([^/]+?)(?:\.[^./]+)?$", 1)
    return F.when(folder != "", folder).otherwise(stem)


def default_table(designs: DataFrame) -> DataFrame:
    """``table_name``: the stored one, else the one that follows from the name."""
    return designs.withColumn("table_name", F.coalesce("embedding_table", table_name(design_name(F.col("config_path")))))


def restore_state(designs: DataFrame, tables: DataFrame) -> DataFrame:
    """Designs whose default table exists count as embedded; ``tables`` has ``table_name``."""
    known = tables.select("table_name", F.lit(True).alias("_has")).distinct()
    return default_table(designs).join(known, "table_name", "left").withColumn("is_embedded", F.coalesce("_has", F.lit(False))).drop("_has")


def embedding_state(designs: DataFrame) -> DataFrame:
    """``config_path, table_name`` of the embedded designs: what is kept between sessions."""
    return default_table(designs.filter("is_embedded")).select("config_path", "table_name").distinct()


def deleted_designs(state: DataFrame, discovered: DataFrame) -> DataFrame:
    return state.join(discovered.select("config_path"), "config_path", "left_anti")


def file_owners(designs: DataFrame) -> DataFrame:
    """``path, design_id, subgraph_name``: the designs a file belongs to, by exact path."""
    federated = designs.select("design_id", F.explode("subgraphs").alias("s")).select(F.col("s.schema_path").alias("path"), "design_id", F.col("s.name").alias("subgraph_name"))
    alone = designs.filter(F.col("type") == "standalone").select(F.col("config_path").alias("path"), "design_id", F.lit(None).cast("string").alias("subgraph_name"))
    return federated.unionByName(alone).filter("path is not null")


def service_of_table(designs: DataFrame, services: DataFrame) -> DataFrame:
    """``table_name, design_id, url`` over ``services(design_id, url)``."""
    return default_table(designs).select("table_name", "design_id").join(services, "design_id")


def group_diagnostics(errors: DataFrame) -> DataFrame:
    """``file, n, diagnostics``: all errors of a file in order of place."""
    d = F.array_sort(F.collect_list(F.struct("line", "column", "severity", "message")))
    return errors.groupBy("file").agg(F.count(F.lit(1)).alias("n"), d.alias("diagnostics"))


_PLACE = "struct<line:int,column:int>"
BUILD_ERRORS = f"struct<error:struct<details:struct<build_errors:array<struct<message:string,code:string,nodes:array<struct<subgraph:string,start:{_PLACE},end:{_PLACE}>>>>>>>"
_PARTS = ["line", "column", "end_line", "end_column"]
_LINE = T.StructType([T.StructField(n, T.IntegerType()) for n in _PARTS])


def build_errors(outputs: DataFrame, output: str = "output", keep: str = "run_id") -> DataFrame:
    """``keep, error_no, message, nodes`` of composition outputs as JSON; unreadable ones give none."""
    parsed = F.from_json(output, BUILD_ERRORS.replace("struct<error:", "error ", 1)[:-1], {"mode": "PERMISSIVE"})
    return outputs.select(keep, F.posexplode(parsed["error"]["details"]["build_errors"]).alias("error_no", "e")).select(keep, "error_no", "e.message", "e.nodes")


def place_errors(errors: DataFrame, subgraphs: DataFrame, keep: str = "run_id") -> DataFrame:
    """``keep, error_no, subgraph_name, file, message, line, column, end_line, end_column`` (lines from 0).

    An error that mentions several subgraphs (``"name"``, ``[name]`` or ``─[ name:line:column ]``) gives a row for each, with the
    name before the message; otherwise its first node's subgraph (whatever the case) places it, else the one it
    mentions, else the first. ``subgraphs`` has ``subgraph_pos, subgraph_name, schema_path`` of one design.
    """
    errors = errors.withColumn("nodes", F.coalesce("nodes", F.array().cast(errors.schema["nodes"].dataType)))
    subs = subgraphs.select("subgraph_pos", "subgraph_name", "schema_path")
    lower = lambda c: F.lower(F.col(c))
    said = F.array_distinct(F.concat(*[F.regexp_extract_all("message", F.lit(p), F.lit(1)) for p in (r'"([^"]+)"', r"\[([^\[\]]+)\]", r"[╭├]─\[\s*([^:\]]+):\d+:\d+\s*\]")]))
    key = [keep, "error_no"]
    mentioned = errors.select(*key, F.explode(said).alias("subgraph_name")).join(subs, "subgraph_name")
    counted = mentioned.groupBy(*key).agg(F.count(F.lit(1)).alias("n_mentioned"))
    node = errors.select(*key, F.lower(F.get("nodes", 0)["subgraph"]).alias("low")).join(subs.withColumn("low", lower("subgraph_name")), "low").drop("low")
    first = subs.orderBy("subgraph_pos").limit(1)  # the design's first subgraph
    options = mentioned.select(*key, "subgraph_pos", "subgraph_name", "schema_path", F.lit(1).alias("rank")).unionByName(node.select(*key, "subgraph_pos", "subgraph_name", "schema_path", F.lit(0).alias("rank"))).unionByName(errors.select(*key).join(F.broadcast(first)).select(*key, "subgraph_pos", "subgraph_name", "schema_path", F.lit(2).alias("rank")))
    best = F.row_number().over(Window.partitionBy(*key).orderBy("rank", "subgraph_pos"))
    ranked = options.join(counted, key, "left").withColumn("several", F.coalesce("n_mentioned", F.lit(0)) > 1).withColumn("best", best)
    kept = ranked.filter((F.col("several") & (F.col("rank") == 1)) | (~F.col("several") & (F.col("best") == 1))).join(errors, key)
    place = F.get(F.filter("nodes", lambda x: F.lower(x["subgraph"]) == F.lower(F.col("subgraph_name"))), 0)
    text = F.when(F.col("several"), F.concat(F.lit("["), "subgraph_name", F.lit("] "), "message")).otherwise(F.col("message"))
    zero = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c) - 1, F.lit(0)))
    return kept.withColumn("node", place).select(*key, "subgraph_name", F.col("schema_path").alias("file"), text.alias("message"), zero("node.start.line").alias("line"), F.col("node.start.column").alias("column"), zero("node.end.line").alias("end_line"), F.col("node.end.column").alias("end_column"))


def locate(sdl: str, target: str) -> dict | None:
    """Line and columns (from 0) of ``Type`` or ``Type.field`` in a text that need not parse; the type's line if the field is not there."""
    type_name, _, field_name = target.partition(".")
    place, inside, depth = None, False, 0
    for i, line in enumerate(sdl.split("\n")):
        m = re.match(r"\s*(?:type|interface|input|enum)\s+(\w+)", line)
        if m and m[1] == type_name:
            inside, depth = True, 0
            place = {"line": i, "column": m.start(1), "end_line": i, "end_column": m.end(1)}
            if not field_name:
                return place
        if inside:
            depth += line.count("{") - line.count("}")
            f = re.search(rf"\b{re.escape(field_name)}\s*(?:\([^)]*\))?\s*:", line) if depth > 0 else None
            if f:
                return {"line": i, "column": f.start(), "end_line": i, "end_column": len(line.rstrip())}
            if depth <= 0 and "}" in line:
                inside = False
    return place


def locate_column(sdl, target):
    @F.pandas_udf(_LINE)
    def run(texts: pd.Series, targets: pd.Series) -> pd.DataFrame:
        found = [locate(s, t) if s is not None and t else None for s, t in zip(texts, targets)]
        return pd.DataFrame([list(p.values()) if p else [None] * len(_PARTS) for p in found], columns=_PARTS, dtype="object")

    return F.when(run(sdl, target)[_PARTS[0]].isNotNull(), run(sdl, target))
