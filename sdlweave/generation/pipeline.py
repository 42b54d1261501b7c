"""From a request in words to a validated operation: search, choice, discovery, generation, repair."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sdlweave.functions.refs import required_arguments
from sdlweave.functions.text import FILLER
from sdlweave.generation.providers import LanguageModel, Message
from sdlweave.operators import graph, search
from sdlweave.operators.embedding import EmbeddingProvider
from sdlweave.operators.rows import merge_chunks
from sdlweave.operators.validation import validate_operation
from sdlweave.schema import EngineConfig
from sdlweave.sdl.lexer import SyntaxProblem
from sdlweave.sdl.parser import parse

_UNKNOWN = re.compile(r"""Cannot query field ["'`]?(\w+)["'`]? on type ["'`]?(\w+)["'`]""", re.I)
USEFUL_CHARS = 30


def code_block(text: str, language: str) -> str:
    for label in (re.escape(language), ""):
        m = re.search(rf"```{label}[ \t]*\n(.*?)```", text, re.S | re.I)
        if m and m[1].strip():
            return m[1].strip()
    return text.strip()


def variables_of(text: str) -> dict[str, Any]:
    m = re.search(r"```json\s*\n(.*?)```", text, re.S | re.I)
    try:
        got = json.loads(m[1]) if m else {}
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


def operation_kind(answer: str) -> str:
    a = answer.lower()
    return "Mutation" if "mutation" in a else "Subscription" if "subscription" in a else "Query"


def unknown_fields(errors: list[str]) -> dict[str, list[str]]:
    """Type to the fields that errors say it lacks."""
    out: dict[str, list[str]] = {}
    for e in errors:
        m = _UNKNOWN.search(e)
        if m and m[1] not in out.setdefault(m[2], []):
            out[m[2]].append(m[1])
    return out


@dataclass
class Result:
    operation: str
    variables: dict[str, Any]
    operation_type: str
    root_field: str
    documents: list[dict[str, Any]]
    attempts: int
    valid: bool
    errors: list[str] = field(default_factory=list)


class Generator:
    """The steps over a document table; each is public. Table work is done by DataFrames, model calls on the driver.

    ``events`` collects ``step, detail`` rows in order; :meth:`event_rows` gives them as a DataFrame.
    """

    def __init__(self, docs: DataFrame, embedder: EmbeddingProvider, model: LanguageModel | None, sdl: str | None = None, config: EngineConfig | None = None, introspect: Callable[[str], str] | None = None, validate: Callable[[str, str | None], list[str]] = validate_operation) -> None:
        self.docs, self.embedder, self.model, self.sdl = docs, embedder, model, sdl
        self.config, self.validator = config or EngineConfig(), validate
        self.introspect = introspect or self.type_text
        self.events: list[tuple[int, str, str]] = []

    def log(self, step: str, detail: object = "") -> None:
        self.events.append((len(self.events), step, str(detail)))

    def event_rows(self) -> DataFrame:
        return self.docs.sparkSession.createDataFrame(self.events, "seq int, step string, detail string")

    # -- search ---------------------------------------------------------------------------------
    def terms(self, request: str) -> str:
        """The request as search words: the model's, else without filler words, else as it is."""
        if self.model:
            try:
                said = self.model.complete([{"role": "system", "content": "Reply with the few nouns and verbs of this request that a schema search needs, nothing else."}, {"role": "user", "content": request}], 0.1, 50).strip()
                if said:
                    return said
            except Exception as e:  # noqa: BLE001 - the raw request still works
                self.log("terms_failed", e)
        return " ".join(w for w in request.split() if w.lower() not in FILLER) or request

    def search(self, request: str) -> DataFrame:
        """Root fields at the highest threshold that any reaches, best first."""
        found = search.top_k(self.docs, self.embedder.embed(request), self.config.max_documents, [search.MetadataFilter("parentType", "in", ["Query", "Mutation", "Subscription"])])
        return search.ladder(found, self.config.min_similarity).withColumn("rootOperationType", F.coalesce("metadata.rootOperationType", "metadata.parentType")).orderBy(F.desc("score"), "id")

    def choose_type(self, request: str, names: list[str]) -> str:
        ask = [{"role": "system", "content": "Decide whether the request reads data (Query), changes data (Mutation) or listens to data (Subscription). Reply with one word."}, {"role": "user", "content": f"Request: {request}\nClosest operations: {', '.join(names[:10])}\nWhich operation type?"}]
        return operation_kind(self._say(ask, 0.1, 50))

    def choose_field(self, request: str, candidates: list[dict[str, Any]]) -> dict[str, Any]:
        """Exact id, else a partial id in score order, else the best."""
        ask: list[Message] = [{"role": "system", "content": "Each assistant message is one operation, its id before the colon. Choose the one that serves the request."}]
        ask += [{"role": "assistant", "content": f"{c['id']}:{c['content']}"} for c in candidates]
        ask.append({"role": "user", "content": f"Request: {request}\nReply with the id of the most relevant operation only."})
        said = self._say(ask, 0.1, 100).strip()
        exact = [c for c in candidates if c["id"] == said]
        part = [c for c in candidates if c["id"] in said or said in c["id"]]
        return (exact or part or candidates)[0]

    # -- discovery ------------------------------------------------------------------------------
    def related(self, root: dict[str, Any]) -> list[dict[str, Any]]:
        """Type documents around the field in order of distance; chunks of a type put together."""
        one = self.docs.filter((F.col("id") == root["id"]) & F.col("collection").eqNullSafe(root.get("collection")))
        found = graph.related_types(self.docs, one, self.config.max_type_depth)
        whole = found.filter(F.col("metadata.chunkIndex").isNull()).select("collection", "type", "name", "content", "depth")
        near = found.groupBy("collection", "name").agg(F.min("depth").alias("depth"))
        joined = merge_chunks(found.drop("depth")).join(near, ["collection", "name"]).select("collection", "type", "name", "content", "depth")
        rows = whole.unionByName(joined.join(whole.select("collection", "name"), ["collection", "name"], "left_anti"))
        return [r.asDict() for r in rows.orderBy("depth", "name").toLocalIterator()]

    def type_text(self, name: str) -> str:
        row = self.docs.filter((F.col("name") == name) & (F.col("type") != "field")).orderBy(F.coalesce("metadata.chunkIndex", F.lit(0))).select("content").first()
        return row["content"] if row else ""

    # -- generation -----------------------------------------------------------------------------
    def generate(self, root: dict[str, Any], types: list[dict[str, Any]], request: str) -> tuple[str, dict[str, Any]]:
        need = self._required(root)
        must = f" These arguments are required and need variables: {need}." if need else ""
        ask: list[Message] = [{"role": "system", "content": f"Write one valid operation with example variables, from the schema parts given. Put the operation in a ```graphql block and the variables in a ```json block.{must}"}, {"role": "assistant", "content": f"Root field:\n{root['content']}"}]
        ask += [{"role": "assistant", "content": f"Type {t['name']}:\n{t['content']}"} for t in types]
        ask.append({"role": "user", "content": f"Write the operation for this request: {request}{must}"})
        said = self._say(ask, self.config.temperature, 2000)
        return code_block(said, "graphql"), variables_of(said)

    def repair(self, operation: str, errors: list[str], root: dict[str, Any], types: list[dict[str, Any]], request: str, stalled: bool) -> str:
        need = self._required(root)
        system = "Correct the operation. Use only fields that the schema parts show; guess none. Reply with the operation in a ```graphql block."
        if need:
            system += f" Keep the required arguments: {need}."
        if stalled:
            system += " The last correction changed nothing: drop the failing selections and build the operation another way."
        ask: list[Message] = [{"role": "system", "content": system}]
        ask += [{"role": "assistant", "content": d["content"]} for d in (root, *types)]
        dead = []
        for name in unknown_fields(errors):
            text = self.introspect(name)
            if len(text) >= USEFUL_CHARS:
                ask.append({"role": "assistant", "content": f"All fields of {name}:\n{text}"})
            else:
                dead.append(name)
        remove = f"\nNothing is known of these types, remove every selection on them: {', '.join(dead)}." if dead else ""
        problems = "\n".join(f"- {e}" for e in errors)
        ask.append({"role": "user", "content": f"The operation has errors:\n```graphql\n{operation}\n```\nErrors:\n{problems}\nRequest: {request}{remove}"})
        return code_block(self._say(ask, 0.4 if stalled else 0.1, 2000), "graphql")

    def validate_and_retry(self, operation: str, root: dict[str, Any], types: list[dict[str, Any]], request: str) -> tuple[str, int, list[str]]:
        """Operation, attempts and remaining errors; at the last attempt the best effort stays."""
        before, attempt = None, 1
        while True:
            errors = self.validator(operation, self.sdl)
            self.log("validate", f"attempt {attempt}: {len(errors)} errors")
            if not errors or attempt >= self.config.max_retries:
                return operation, attempt, errors
            key = "|".join(sorted(errors))
            operation = self.repair(operation, errors, root, types, request, key == before)
            before, attempt = key, attempt + 1

    def run(self, request: str) -> Result:
        """All steps. Raises LookupError if no root field is found for the request or for its operation type."""
        if not request.strip():
            raise ValueError("empty request")
        words = self.terms(request) if self.config.extract_terms else request
        self.log("terms", words)
        found = [r.asDict(recursive=True) for r in self.search(words).toLocalIterator()]  # at most max_documents rows
        self.log("search", len(found))
        if not found:
            raise LookupError("no root fields match; is the collection filled?")
        kind = self.choose_type(request, [f["name"] for f in found])
        self.log("type", kind)
        candidates = [f for f in found if f["rootOperationType"] == kind]
        if not candidates:
            raise LookupError(f"no {kind} fields match")
        root = self.choose_field(request, candidates)
        self.log("field", root["name"])
        types = self.related(root)
        self.log("types", len(types))
        operation, variables = self.generate(root, types, request)
        operation, attempts, errors = self.validate_and_retry(operation, root, types, request)
        self.log("done", attempts)
        return Result(operation, variables, kind.lower(), root["name"], candidates + [{**t, "score": 1.0} for t in types], attempts, not errors, errors)

    def keyword_fallback(self, request: str, limit: int = 10) -> Result:
        """Without vectors: documents by words in common, then generation; type and root field are read off the operation."""
        words = [w.lower() for w in self.terms(request).split()] or [request.lower()]
        hits = sum(F.when(F.lower("content").contains(w), 1).otherwise(0) for w in words)
        rows = [r.asDict(recursive=True) for r in self.docs.withColumn("hits", hits).filter("hits > 0").orderBy(F.desc("hits"), "id").limit(limit).drop("embedding").toLocalIterator()]
        root = next((r for r in rows if (r["metadata"] or {}).get("isRootOperationField")), None) or (rows[0] if rows else {"content": "", "metadata": None})
        operation, variables = self.generate(root, [r for r in rows if r is not root], request)
        operation, attempts, errors = self.validate_and_retry(operation, root, rows, request)
        kind, name = root_of(operation)
        return Result(operation, variables, kind, name, rows, attempts, not errors, errors)

    # -- helpers --------------------------------------------------------------------------------
    def _required(self, root: dict[str, Any]) -> str:
        args = (root.get("metadata") or {}).get("arguments") or []
        return ", ".join(f"{a['name']} ({a['type']})" for a in args if (a["type"] or "").strip().endswith("!"))

    def _say(self, messages: list[Message], temperature: float, max_tokens: int) -> str:
        if self.model is None:
            raise RuntimeError("no model is set")
        return self.model.complete(messages, temperature, max_tokens)


def root_of(operation: str) -> tuple[str, str]:
    """Operation type and first root field of a text; query and '' if it does not parse."""
    try:
        d = next(x for x in parse(operation) if x.kind == "Operation")
        return d.type, next((s.name for s in d.items if s.kind == "Field"), "")
    except (SyntaxProblem, StopIteration):
        return "query", ""


def required(docs: DataFrame) -> DataFrame:
    """Root fields with their required arguments, for reports."""
    return docs.filter("metadata.isRootOperationField").select("collection", "name", required_arguments(F.col("metadata.arguments")).alias("required"))
