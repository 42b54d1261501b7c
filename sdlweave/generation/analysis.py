"""A best-practice report on a schema from its documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sdlweave.generation.providers import LanguageModel
from sdlweave.operators.rows import group_fields
from sdlweave.operators.search import limit_per

CATEGORIES = {"query": "Query Design", "mutation": "Mutation Design", "subscription": "Subscription Design", "type": "Type Design", "field": "Field Design"}

#: Guidance given to the model; our own words.
PRACTICES = """Name fields for what they return and keep one style of case.
Prefer specific object types to loosely typed JSON, and enums to free strings.
Return lists that can grow as pages with cursors.
Give mutations one input object and a payload that holds the changed object and expected errors.
Make a field nullable unless it can never be missing.
Describe every type, field and argument, and deprecate before removing."""


@dataclass
class Report:
    markdown: str
    document_count: int
    categories: list[str]


def categorised(docs: DataFrame) -> DataFrame:
    """Documents with ``category``: root fields by operation, types, and all other fields."""
    parent = F.col("metadata.parentType")
    root = F.when(parent.isin("Query", "Mutation", "Subscription"), F.lower(parent))
    return docs.withColumn("category", F.when(F.col("type") == "field", F.coalesce(root, F.lit("field"))).otherwise("type"))


def counts(docs: DataFrame, limit: int = 500) -> DataFrame:
    """``category, n, taken``: all documents of each category, and how many a report looks at."""
    return categorised(docs).groupBy("category").agg(F.count(F.lit(1)).alias("n")).withColumn("taken", F.least("n", F.lit(limit)))


def summary(docs: DataFrame, limit: int = 500) -> str:
    """The report's input: at most ``limit`` documents a category, fields by parent."""
    top = limit_per(categorised(docs), "category", ["ordinal", "id"], limit)  # bounded: five categories
    parts = []
    for key, title in (("type", "Types"), ("query", "Query fields"), ("mutation", "Mutation fields"), ("subscription", "Subscription fields")):
        texts = [r["content"] for r in top.filter(F.col("category") == key).orderBy("ordinal", "id").select("content").toLocalIterator()]
        parts += [f"## {title}", *texts] if texts else []
    grouped = group_fields(top.filter("category = 'field'"), F.col("metadata.parentType"), "ordinal", "content").orderBy("parent")
    fields = [f"### {r['parent']}\n{r['body']}" for r in grouped.toLocalIterator()]
    return "\n\n".join(parts + (["## Fields by parent", *fields] if fields else []))


def analyse(docs: DataFrame, model: LanguageModel, limit: int = 500) -> Report:
    """One model call over the summary. Raises LookupError on an empty collection."""
    got = {r["category"]: r["taken"] for r in counts(docs, limit).collect()}  # five rows at most
    if not got:
        raise LookupError("the collection is empty")
    ask = [{"role": "system", "content": "Review this schema against the guidance and answer in Markdown with one section per topic.\n\n" + PRACTICES}, {"role": "user", "content": "Review the schema:\n\n" + summary(docs, limit)}]
    return Report(model.complete(ask, 0.2, 4000), sum(got.values()), [t for k, t in CATEGORIES.items() if got.get(k)])
