"""Type-reference graph: edges and level-wise discovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sdlweave.functions.refs import base_type
from sdlweave.runtime import stage
from sdlweave.sdl.parser import BUILTIN_SCALARS

MAX_DEPTH = 5


def edges(docs: DataFrame) -> DataFrame:
    """``collection, src, dst, kind`` over the type names of documents: field types, union members, interfaces.

    Arguments of nested fields are not followed, nor an interface's implementers. Scalars are left out.
    """
    field = docs.filter(F.col("type") == "field").select("collection", F.col("metadata.parentType").alias("src"), base_type(F.col("metadata.fieldType")).alias("dst"), F.lit("field").alias("kind"))
    member = docs.select("collection", F.col("name").alias("src"), F.explode("metadata.possibleTypes").alias("dst"), F.lit("member").alias("kind"))
    implemented = docs.select("collection", F.col("name").alias("src"), F.explode("metadata.interfaces").alias("dst"), F.lit("interface").alias("kind"))
    return field.unionByName(member).unionByName(implemented).filter(F.col("src").isNotNull() & F.col("dst").isNotNull() & ~F.col("dst").isin(*BUILTIN_SCALARS)).distinct()


def bfs(links: DataFrame, seeds: DataFrame, max_depth: int | None = MAX_DEPTH, keys: Sequence[str] = ()) -> DataFrame:
    """``*keys, node, depth``: nodes reached from ``seeds(*keys, node)`` over ``links(*keys, src, dst)``, by fewest steps.

    One join a level; every level is staged, and the loop ends with an empty frontier or at the depth.
    """
    k = list(keys)
    front = stage(seeds.select(*k, "node").distinct().withColumn("depth", F.lit(0)))
    seen, depth = front, 0
    while (max_depth is None or depth < max_depth) and not front.isEmpty():
        depth += 1
        reached = links.join(front.select(*k, F.col("node").alias("src")), [*k, "src"]).select(*k, F.col("dst").alias("node")).distinct()
        front = stage(reached.join(seen.select(*k, "node"), [*k, "node"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = stage(seen.unionByName(front))  # one table a round, so no plan grows with the rounds
    return seen


def related_types(docs: DataFrame, root_field: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Type documents around root fields, with ``depth`` from 1: seeds are the field's type and its arguments' types.

    Names without a document are dropped.
    """
    names = F.concat(F.array(F.col("metadata.fieldType")), F.coalesce(F.transform("metadata.arguments", lambda a: a["type"]), F.array().cast("array<string>")))
    seeds = root_field.select("collection", F.explode(names).alias("t")).select("collection", base_type(F.col("t")).alias("node")).filter(F.col("node").isNotNull() & ~F.col("node").isin(*BUILTIN_SCALARS))
    reached = bfs(edges(docs), seeds, max_depth - 1, ["collection"]).withColumn("depth", F.col("depth") + 1)
    types = docs.filter(F.col("type") != "field")
    return types.join(reached.withColumnRenamed("node", "name"), ["collection", "name"])
