"""References to records that do not exist (problem 5).

Keys ``(collection, name)`` are dictionary-encoded: the distinct keys that are referred to or are targets get an integer,
dense within a partition, whose high bits are the key range. References become ``key, month, field`` with a count, targets
``key`` with their times. Per key range, month of load and reference field the referenced ids become a compressed bitmap;
per key range the ids of the targets become another, and of the removed ones a third. Reference AND-NOT parent leaves the
missing keys, reference AND removed the deleted ones; the surviving bits are decoded, name the rows and give the report. A hot
key is one dictionary row and one bit per month and field, whatever its row count; only the last join sees its rows, and
that one is a broadcast of a counted table or a salted join. Whether a reference came too early for its target is a matter of
the row's own time, so those rows are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sdlweave.functions import bitmaps
from sdlweave.functions.refs import base_type
from sdlweave.runtime import join_checked, stage

LATE_HOURS = 24
_WAIT = f"INTERVAL {LATE_HOURS} HOURS"
#: A null collection is a collection of its own, a null time a month of its own.
_NO_COLLECTION, _NO_MONTH = "\x00", -1


def references(docs: DataFrame, builtin: DataFrame) -> DataFrame:
    """``row_id, collection, loaded_at, ref_field, ref_name``: each distinct reference of a row.

    Null metadata, null and empty references and built-in names give no row.
    """
    one = lambda name: F.array(F.struct(F.lit(name).alias("f"), F.col(f"metadata.{name}").alias("v")))
    many = F.coalesce(F.transform(F.col("metadata.possibleTypes"), lambda x: F.struct(F.lit("possibleTypes").alias("f"), x.alias("v"))), F.array().cast("array<struct<f:string,v:string>>"))
    raw = F.filter(F.concat(one("fieldType"), one("parentType"), many), lambda x: x["v"].isNotNull())
    clean = F.array_distinct(F.transform(raw, lambda x: F.struct(x["f"].alias("ref_field"), base_type(x["v"]).alias("ref_name"))))
    refs = docs.select("row_id", "collection", "loaded_at", F.inline(clean)).filter(F.col("ref_name") != "")
    # the table of built-in names is fixed and small; the planner broadcasts it by its size
    return refs.join(builtin.select(F.col("name").alias("ref_name")), "ref_name", "left_anti").select("row_id", "collection", "loaded_at", "ref_field", "ref_name")


def _collection() -> Column:
    return F.coalesce("collection", F.lit(_NO_COLLECTION)).alias("_c")


class Encoded(NamedTuple):
    """``keys`` (key_id, _c, name), ``uses`` (key_id, month, ref_field, n, first_ref) and ``parents`` (key_id, lo, hi, gone), all staged."""

    keys: DataFrame
    uses: DataFrame
    parents: DataFrame


def encoded(docs: DataFrame, refs: DataFrame, removals: DataFrame) -> Encoded:
    """Dictionary-encode both sides; ``month`` counts from year 0."""
    month = F.coalesce(F.year("loaded_at") * 12 + F.month("loaded_at") - 1, F.lit(_NO_MONTH)).alias("month")
    uses = refs.groupBy(_collection(), F.col("ref_name").alias("name"), month, "ref_field").agg(F.count(F.lit(1)).alias("n"), F.min("loaded_at").alias("first_ref"))
    targets = docs.filter(F.col("type") != "field").groupBy(_collection(), "name").agg(F.min("loaded_at").alias("lo"), F.max("loaded_at").alias("hi"))
    gone = removals.groupBy(_collection(), F.col("type_name").alias("name")).agg(F.max("removed_at").alias("gone"))
    uses, targets = stage(uses), stage(targets.filter(F.col("name").isNotNull()).join(gone, ["_c", "name"], "left"))
    names = uses.select("_c", "name").union(targets.select("_c", "name")).distinct()
    keys = stage(names.withColumn("key_id", F.monotonically_increasing_id()))  # frozen by staging: partition << 33 | position
    return Encoded(keys, stage(uses.join(keys, ["_c", "name"]).drop("_c", "name")), stage(targets.join(keys, ["_c", "name"]).drop("_c", "name")))


def _build(t: pa.Table) -> pa.Table:
    ids = t["position"].combine_chunks().sort().to_numpy(zero_copy_only=False)
    return t.slice(0, 1).drop_columns(["position"]).append_column("bits", pa.array([bitmaps.encode(ids)], pa.binary()))


def bitmap(ids: DataFrame, by: dict[str, str] | None = None) -> DataFrame:
    """``range, *by, bits``: a compressed bitmap of the distinct ``key_id`` of each key range and value of ``by`` (names to types)."""
    by = by or {}
    spots = ids.select(F.shiftright("key_id", 16).alias("range"), *by, F.col("key_id").bitwiseAND(F.lit(bitmaps.RANGE - 1)).cast("int").alias("position"))
    shape = "".join(f", {n} {k}" for n, k in by.items())
    return spots.groupBy("range", *by).applyInArrow(_build, f"range long{shape}, bits binary")  # at most RANGE positions a group


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ref, par, gone = (b.column(c).to_pylist() for c in ("bits", "par", "gone"))
        for status, made in (("missing", [bitmaps.and_not(r, p) for r, p in zip(ref, par)]), ("deleted", [bitmaps.both(r, g) for r, g in zip(ref, gone)])):
            yield pa.RecordBatch.from_arrays([b.column("range"), b.column("month"), b.column("ref_field"), pa.array([status] * b.num_rows), pa.array(made, pa.binary())], names=["range", "month", "ref_field", "status", "bits"])


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, (at, data) in enumerate(zip(b.column("range").to_pylist(), b.column("bits").to_pylist())):
            found = bitmaps.decode(data)
            if len(found):
                take = pa.array([i] * len(found), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(found + (at << 16)), *[b.column(c).take(take) for c in ("month", "ref_field", "status")]], names=["key_id", "month", "ref_field", "status"])


def surviving(e: Encoded) -> DataFrame:
    """``range, month, ref_field, status, bits``: reference AND-NOT parent as missing, reference AND removed as deleted."""
    ref = bitmap(e.uses, {"month": "int", "ref_field": "string"})
    par = bitmap(e.parents).withColumnRenamed("bits", "par")
    gone = bitmap(e.parents.filter("gone > hi")).withColumnRenamed("bits", "gone")
    return ref.join(par, "range", "left").join(gone, "range", "left").mapInArrow(_decide, "range long, month int, ref_field string, status string, bits binary")


def decoded(bits: DataFrame) -> DataFrame:
    """``key_id, month, ref_field, status`` of each bit that is set."""
    return bits.mapInArrow(_decoded, "key_id long, month int, ref_field string, status string")


def _late(refs: DataFrame, e: Encoded) -> DataFrame:
    """References of rows that were loaded too long before the first target of a key that is not deleted."""
    first = e.uses.groupBy("key_id").agg(F.min("first_ref").alias("first_ref"))
    some = e.parents.filter("gone is null or hi is null or gone <= hi").join(first, "key_id").filter(F.col("lo") > F.col("first_ref") + F.expr(_WAIT))
    keys = stage(some.select("key_id", "lo").join(e.keys, "key_id").select("_c", F.col("name").alias("ref_name"), "lo"))
    found = join_checked(refs.withColumn("_c", _collection()), keys, ["_c", "ref_name"]).filter(F.col("lo") > F.col("loaded_at") + F.expr(_WAIT))
    return found.select("row_id", "collection", "loaded_at", "ref_field", "ref_name", F.lit("late").alias("status"))


def orphan_references(docs: DataFrame, removals: DataFrame, builtin: DataFrame) -> DataFrame:
    """``row_id, collection, loaded_at, ref_field, ref_name, status`` with status missing, deleted or late.

    Rows with a null ``loaded_at`` can be missing or deleted but never late. Empty tables give no rows.
    """
    refs = references(docs, builtin)
    e = encoded(docs, refs, removals)
    known = decoded(surviving(e)).select("key_id", "status").distinct()
    keys = stage(known.join(e.keys, "key_id").select("_c", F.col("name").alias("ref_name"), "status"))
    found = join_checked(refs.withColumn("_c", _collection()), keys, ["_c", "ref_name"])
    return found.select("row_id", "collection", "loaded_at", "ref_field", "ref_name", "status").unionByName(_late(refs, e))


def orphan_report(docs: DataFrame, removals: DataFrame, builtin: DataFrame) -> DataFrame:
    """``collection, month, ref_field, status, n_refs, n_names`` per collection and month of load, from the bits.

    A bit is a name; the references it stands for were counted when they were encoded. Late ones are counted by rows.
    """
    refs = references(docs, builtin)
    e = encoded(docs, refs, removals)
    names = decoded(surviving(e)).join(e.uses.select("key_id", "month", "ref_field", "n"), ["key_id", "month", "ref_field"]).join(e.keys, "key_id")
    when = F.when(F.col("month") >= 0, F.format_string("%04d-%02d", F.floor(F.col("month") / 12), F.col("month") % 12 + 1))
    known = names.groupBy("_c", "month", "ref_field", "status").agg(F.sum("n").alias("n_refs"), F.count(F.lit(1)).alias("n_names"))
    known = known.select(F.when(F.col("_c") != _NO_COLLECTION, F.col("_c")).alias("collection"), when.alias("month"), "ref_field", "status", "n_refs", "n_names")
    late = _late(refs, e).groupBy("collection", F.date_format("loaded_at", "yyyy-MM").alias("month"), "ref_field", "status").agg(F.count(F.lit(1)).alias("n_refs"), F.count_distinct("ref_name").alias("n_names"))
    return known.unionByName(late)
