"""String expressions: identifiers, names, previews, code blocks and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def content_id(text: Column) -> Column:
    """The 32-bit UTF-16 hash of a text, absolute, in base 36. Null stays null.

    ``reflect`` calls the JVM's own string hash; Spark counts it as non-deterministic, so project it, don't filter by it.
    """
    h = F.reflect(F.lit("java.util.Objects"), F.lit("hashCode"), text).cast("long")
    return F.when(text.isNotNull(), F.lower(F.conv(F.abs(h).cast("string"), 10, 36)))


def table_name(name: Column, fallback: str = "embeddings") -> Column:
    """A collection's table name from a design name: lower case, ``_`` for other runs, with the suffix."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(clean, F.lit("")) == "", fallback).otherwise(F.concat(clean, F.lit("_embeddings")))


def valid_table_name(name: Column) -> Column:
    return name.rlike(r"\A[a-zA-Z_][a-zA-Z0-9_]*\z")


def is_camel(name: Column) -> Column:
    return name.rlike(r"^_*[a-z][a-zA-Z0-9]*$")


def is_pascal(name: Column) -> Column:
    return name.rlike(r"^[A-Z][a-zA-Z0-9]*$")


def is_screaming(name: Column) -> Column:
    return name.rlike(r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$")


def rest_verb(name: Column) -> Column:
    """The verb of a REST-like field name, '' if it has none."""
    return F.regexp_extract(name, r"^(get|list|post|put|patch)[A-Z]", 1)


def is_schema_text(text: Column) -> Column:
    return text.rlike(r"\b(type|interface|enum|union|scalar|input|schema|extend)\s")


def code_block(text: Column, language: str) -> Column:
    """The first fenced block of the language, else the first unlabelled one, else the trimmed text."""
    labelled = F.regexp_extract(text, rf"(?is)```{language}\s*\n(.*?)```", 1)
    plain = F.regexp_extract(text, r"(?s)```\s*\n(.*?)```", 1)
    return F.coalesce(F.nullif(strip(labelled), F.lit("")), F.nullif(strip(plain), F.lit("")), strip(text))


def json_variables(text: Column) -> Column:
    """JSON text of the block labelled json; ``{}`` if there is none or it does not parse."""
    block = F.nullif(strip(F.regexp_extract(text, r"(?is)```json\s*\n(.*?)```", 1)), F.lit(""))
    return F.when(F.try_parse_json(block).isNotNull(), block).otherwise("{}")


def missing_field(message: Column) -> Column:
    """``struct<field, type>`` named by an unknown-field message; nulls otherwise."""
    pattern = r"""(?i)Cannot query field ["'`]?(\w+)["'`]? on type ["'`]?(\w+)["'`]"""
    pick = lambda g: F.nullif(F.regexp_extract(message, pattern, g), F.lit(""))
    return F.struct(pick(1).alias("field"), pick(2).alias("type"))


def error_key(errors: Column) -> Column:
    """Key of a set of errors, whatever their order; equal keys mean a stalled repair."""
    return F.array_join(F.array_sort(errors), "|")


def preview(text: Column, length: int = 120) -> Column:
    return F.substring(text, 1, length)


def prompt_header(query: Column, operation: Column) -> Column:
    return F.concat(F.lit("# Prompt: "), query, F.lit("\n"), operation)


def score_bucket(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.5, "medium").otherwise("low")


def score_bar(score: Column) -> Column:
    """Length of a score's bar: 80 at 1.0, 10 at least. Halves round up."""
    return F.greatest(F.lit(10), F.floor(score * 80 + 0.5).cast("int"))


def duration(ms: Column) -> Column:
    """``12ms``, ``3.4s`` or ``2m 5.0s``; tenths of a second, halves up."""
    tenths = lambda x: F.floor((x + 50) / 100).cast("long")
    shown = lambda x: F.concat(F.floor(tenths(x) / 10).cast("string"), F.lit("."), (tenths(x) % 10).cast("string"), F.lit("s"))
    return (
        F.when(ms < 1000, F.concat(F.floor(ms + F.lit(0.5)).cast("string"), F.lit("ms")))
        .when(ms < 60_000, shown(ms))
        .otherwise(F.concat(F.floor(ms / 60_000).cast("string"), F.lit("m "), shown(ms % 60_000)))
    )


def endpoint(host: Column) -> Column:
    """A host without trailing slashes and with a scheme."""
    clean = F.regexp_replace(F.trim(host), "/+$", "")
    return F.when(clean.rlike("^https?://"), clean).otherwise(F.concat(F.lit("https://"), clean))


#: The filler words that a search text loses.
FILLER = ("get", "all", "with", "their", "find", "show", "me", "the", "a", "an", "of", "for", "by", "and", "or")


def search_terms(text: Column) -> Column:
    """The text without filler words; the text itself if nothing would be left."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: ~F.lower(w).isin(*FILLER))
    return F.coalesce(F.nullif(F.array_join(words, " "), F.lit("")), text)


def token_count(text: Column) -> Column:
    """Words and single signs: the offline stand-in for a model's tokenizer."""
    return F.size(F.regexp_extract_all(text, F.lit(r"\w+|[^\w\s]"), F.lit(0)))


def operation_type(answer: Column) -> Column:
    """Root type named in a model's answer: mutation before subscription before query."""
    a = F.lower(answer)
    return F.when(a.contains("mutation"), "Mutation").when(a.contains("subscription"), "Subscription").otherwise("Query")
