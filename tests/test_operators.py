"""Collections, sync, lint switches, generation, sources and streams on small inputs."""

import json
import time

import pytest
from helpers import same
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sdlweave.generation import analysis
from sdlweave.generation.pipeline import Generator, code_block, operation_kind, unknown_fields, variables_of
from sdlweave.generation.providers import HttpModel, ScriptedModel, complete_with_tools, merge_messages
from sdlweave.operators import lint, rows, search
from sdlweave.operators.collection import ConcurrentChange, VectorCollection, clear_entities, collections, query_or_near_zero, replace_entities, sentinel, upsert_external, without_sentinel
from sdlweave.operators.embedding import HashingEmbedder, embed_documents
from sdlweave.operators.predicates import ColumnFilter, MetadataFilter, condition
from sdlweave.operators.sync import EmbeddingService, document_frame, embed_and_store, sync
from sdlweave.operators.validation import first_event, read_validation, validate_operation, validate_schema
from sdlweave.plans.fixtures import SHOP
from sdlweave.schema import EngineConfig
from sdlweave.sources import files, introspection
from sdlweave.streaming import jobs

LONG = "type Long {" + " ".join(f'"about field number {i}" field{i}: String' for i in range(60)) + "}"


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    c = VectorCollection(spark, str(tmp_path_factory.mktemp("c")), "shop_embeddings")
    sync(spark, SHOP, c, HashingEmbedder())
    return c


def test_collection_round_trip(spark, tmp_path):
    root, e = str(tmp_path), HashingEmbedder()
    c = VectorCollection(spark, root, "t_embeddings").create()
    assert c.count() == 0 and c.sdl() is None and collections(spark, root) == ["t_embeddings"]
    docs = document_frame(spark, SHOP, "t")
    c.upsert(embed_documents(docs, e))
    c.upsert(embed_documents(docs.withColumn("name", F.concat("name", F.lit("2"))), e))
    assert c.count() == docs.select("id").distinct().count() and c.read().filter("name like '%2'").count() == c.count()
    first = c.search(e.embed("order"), 3, columns=[ColumnFilter("type", "eq", "field")])
    assert first.count() == 3 and "embedding" not in first.columns
    ids = [r["id"] for r in c.read().limit(2).collect()]
    n = c.count()
    c.delete([])
    c.delete(ids)
    assert c.count() == n - 2
    c.store_sdl("a")
    c.store_sdl("b")
    assert c.sdl() == "b" and c.sdl(None, "mem") == "mem"
    c.clear()
    assert c.count() == 0 and c.sdl() is None
    with pytest.raises(ValueError):
        VectorCollection(spark, root, "no-good")


def test_failed_write_leaves_the_old_version(spark, tmp_path):
    c = VectorCollection(spark, str(tmp_path), "t").create()
    c.upsert(embed_documents(document_frame(spark, SHOP, "t"), HashingEmbedder()))
    n = c.count()
    bad = c.read().withColumn("ordinal", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception):
        c.upsert(bad)
    assert c.count() == n


def test_budget_routing(spark, tmp_path):
    class Small(HashingEmbedder):
        pass

    e = Small(16, 40)
    c = VectorCollection(spark, str(tmp_path), "t")
    text = LONG + " type Short { a: Int } union Wide = " + " | ".join(f"T{i}" for i in range(60)) + "".join(f" type T{i} {{ a: Int }}" for i in range(60))
    report = embed_and_store(document_frame(spark, text, "t"), c, e).first()
    got = c.read()
    assert report["chunked"] == 1 and report["skipped"] == 1 and report["collisions"] == 0
    assert got.filter("name = 'Wide'").count() == 0 and got.filter("name = 'Long' and type = 'object'").count() > 1
    merged = rows.merge_chunks(got.filter("type = 'object'")).first()
    assert merged["complete"] and merged["content"].count("field") == LONG.count("field")
    assert all(e.count_tokens(r["content"]) <= 40 for r in got.collect())


def test_incremental_sync(spark, tmp_path):
    c, e = VectorCollection(spark, str(tmp_path), "t"), HashingEmbedder(16, 60)
    first = sync(spark, SHOP + LONG, c, e)
    assert first["deleted"] == 0 and first["added"] > 60
    again = sync(spark, SHOP + LONG, c, e)
    assert (again["added"], again["deleted"]) == (0, 0) and again["unchanged"] == first["added"]
    assert c.read().filter("name = 'Long'").count() > 1
    less = sync(spark, SHOP.replace("Note: String", "Memo: String"), c, e)
    assert less["deleted"] == 63 and less["added"] == 2  # chunks of the oversized type go with it
    assert c.read().filter("name = 'Long' or metadata.parentType = 'Long'").count() == 0
    c.store_sdl("type {")
    assert sync(spark, SHOP, c, e)["deleted"] == 0


def test_service(spark, tmp_path):
    s = EmbeddingService(VectorCollection(spark, str(tmp_path), "t"), HashingEmbedder()).initialize()
    assert s.sync(SHOP)["added"] == s.count() > 10
    hits = s.search("place order input", 3).collect()
    assert hits[0]["score"] >= hits[1]["score"] >= hits[2]["score"] and "rder" in hits[0]["content"]
    s.delete([hits[0]["id"]])
    assert s.search("place order input", 1).first()["id"] != hits[0]["id"]
    n = s.count()
    assert s.collection.vacuum() > 2 and s.count() == n and s.collection.vacuum() == 0
    s.clear()
    assert s.count() == 0


def test_folder_keeps_in_step(spark, tmp_path):
    folder, c, seen = tmp_path / "in", VectorCollection(spark, str(tmp_path / "c"), "t"), []
    folder.mkdir()
    state = str(tmp_path / "state")
    (folder / "a.graphql").write_text(SHOP)
    assert jobs.sync_folder(spark, str(folder), c, HashingEmbedder(), state) == 1
    n = c.count()
    assert jobs.sync_folder(spark, str(folder), c, HashingEmbedder(), state) == 0
    (folder / "a.graphql").write_text(SHOP + " scalar More")  # the same name again
    assert jobs.sync_folder(spark, str(folder), c, HashingEmbedder(), state) == 1
    assert c.count() == n + 1
    (folder / "b.graphql").write_text("scalar Other")
    (folder / "a.graphql").unlink()
    handle = lambda df, _: seen.extend((r["path"][-9:], r["change"], r["sdl"]) for r in df.collect())
    jobs.poll(spark, str(folder), handle, state)
    assert sorted(seen) == [("a.graphql", "deleted", None), ("b.graphql", "added", "scalar Other")]
    with pytest.raises(ZeroDivisionError):
        (folder / "b.graphql").write_text("scalar Again")
        jobs.poll(spark, str(folder), lambda df, _: 1 / 0, state)
    seen.clear()
    jobs.poll(spark, str(folder), handle, state)  # handed over again
    assert seen == [("b.graphql", "modified", "scalar Again")]


def test_stream_sees_a_rewritten_file(spark, tmp_path):
    folder, c = tmp_path / "in", VectorCollection(spark, str(tmp_path / "c"), "t")
    folder.mkdir()
    (folder / "a.graphql").write_text("scalar A")
    q = jobs.sync_stream(spark, str(folder), c, HashingEmbedder(), str(tmp_path / "state"))
    try:
        for text, n in (("scalar A", 1), ("scalar A scalar B", 2)):
            (folder / "a.graphql").write_text(text)
            for _ in range(120):
                if c.count() == n:
                    break
                time.sleep(0.5)
            assert c.count() == n
    finally:
        q.stop()


def test_retry_state(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, keys in enumerate((["a", "b"], ["b"])):
        spark.createDataFrame([("r", k) for k in keys], "request_id string, error_key string").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema("request_id string, error_key string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = jobs.retry_states(stream, 3).writeStream.outputMode("update").format("memory").queryName("retries").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    out.awaitTermination()
    last = spark.table("retries").orderBy(F.desc("attempts")).first()
    assert last["attempts"] == 3 and last["exhausted"]


def test_late_events_need_a_watermark(spark, data, tmp_path):
    stream = spark.readStream.schema(spark.read.parquet(f"{data}/events.parquet").schema).parquet(f"{data}/events.parquet*")
    out = jobs.late_counts(stream).writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    out.awaitTermination()
    assert spark.table("late").count() > 0


def test_entities_are_replaced_by_design(spark, tmp_path):
    path = str(tmp_path / "e")
    df = lambda *r: spark.createDataFrame(list(r), "design_id string, type_name string")
    replace_entities(df(("a", "X"), ("a", "Y"), ("b", "Z")), path)
    replace_entities(df(("a", "W")), path)
    read = lambda: sorted((r["design_id"], r["type_name"]) for r in spark.read.schema("type_name string, design_id string").parquet(path).collect())
    assert sorted((r["design_id"], r["type_name"]) for r in spark.read.parquet(path).collect()) == [("a", "W"), ("b", "Z")]
    replace_entities(df(("c", "V")).limit(0), path, ["a", "none"])
    assert read() == [("b", "Z")]
    replace_entities(df(("c/d", "V"), ("e", "U")), path)
    clear_entities(spark, path, "c/d")
    assert read() == [("b", "Z"), ("e", "U")]
    clear_entities(spark, path)
    assert read() == []


def test_index_of_a_collection(spark, data, tmp_path):
    stored = spark.read.parquet(f"{data}/stored_documents.parquet").select(F.col("stored_id").cast("string").alias("id"), "type", "name", "content", "embedding")
    c = VectorCollection(spark, str(tmp_path), "v").create()
    c.upsert(stored)
    probes = c.build_index(lists=40, target=0.95)
    assert 1 <= probes <= 40
    asked = [r["embedding"] for r in stored.filter("embedding is not null and size(embedding) = 64 and exists(embedding, x -> x <> 0) and not exists(embedding, x -> isnan(x))").orderBy(F.xxhash64("id")).limit(12).collect()]
    hit = total = 0
    for q in asked:
        got, want = ({r["id"] for r in c.search(q, 10, probes=p).collect()} for p in (None, 0))
        hit, total = hit + len(got & want), total + len(want)
    assert hit >= 0.9 * total
    c.upsert(spark.createDataFrame([("new", [float(x) for x in asked[0]])], "id string, embedding array<float>"))
    assert "new" in {r["id"] for r in c.search(asked[0], 30).collect()}


def test_a_change_rewrites_its_buckets_only(spark, tmp_path):
    c = VectorCollection(spark, str(tmp_path), "t", buckets=8).create()
    c.upsert(spark.createDataFrame([(str(i), [1.0]) for i in range(200)], "id string, embedding array<float>"))
    before = c._manifest()[1]["buckets"]
    c.upsert(spark.createDataFrame([("7", [2.0])], "id string, embedding array<float>"))
    after = c._manifest()[1]["buckets"]
    assert len(before) == 8 == len(after) and sum(before[b] != after[b] for b in before) == 1
    assert c.count() == 200 and c.read().filter("id = '7'").first()["embedding"] == [2.0]
    number, manifest = c._manifest()
    c.delete(["7"])
    with pytest.raises(ConcurrentChange):
        c._publish(number, manifest)  # a writer that began from the version before
    assert c.count() == 199 and c.vacuum() > 0 and c.count() == 199


def test_external_upsert_in_batches(spark, tmp_path):
    folder = str(tmp_path)
    df = spark.createDataFrame([(str(i), [1.0, 2.0] if i % 10 else None, "object", None) for i in range(450)], "id string, embedding array<float>, type string, name string").coalesce(1)

    def connect():
        import json
        import uuid

        def send(namespace, records):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                json.dump([namespace, records], f)

        return send

    upsert_external(df, connect, "shop")
    import os

    sent = [json.load(open(f"{folder}/{n}")) for n in os.listdir(folder)]
    assert sorted(len(r) for _, r in sent) == [5, 100, 100, 100, 100] and {n for n, _ in sent} == {"shop"}
    assert sent[0][1][0]["metadata"] == {"type": "object"}
    assert query_or_near_zero([0.0, 0.0]) == [1e-7, 1e-7] and query_or_near_zero([0.0, 2.0]) == [0.0, 2.0]
    mixed = spark.createDataFrame([("a",), (sentinel("type A", 2)["id"],), (None,)], "id string")
    assert without_sentinel(mixed).count() == 2


def test_schema_texts_as_files(spark, tmp_path):
    path = str(tmp_path / "s")
    files.write_sdl(spark.createDataFrame([("a", "type A {\n x: Int }"), ("b", "type B")], "name string, sdl string"), path)
    files.write_sdl(spark.createDataFrame([("b", "type C")], "name string, sdl string"), path)
    got = {r["name"]: r["value"].strip() for r in spark.read.text(path, wholetext=True).collect()}
    assert got == {"a": "type A {\n x: Int }", "b": "type C"}


@given(st.lists(st.floats(-1, 1), min_size=1, max_size=20))
def test_ladder_is_the_loop(scores):
    t, loop = 0.4, None
    while True:
        if any(s >= t for s in scores):
            loop = t
            break
        if round(t - 0.05, 2) < 0:
            break
        t = round(t - 0.05, 2)
    assert max((r for r in search.rungs() if r <= max(scores)), default=None) == loop


def test_predicates(spark):
    df = spark.createDataFrame([(1, ("String", True, 3)), (2, (None, False, None)), (3, None)], "i int, metadata struct<f:string,b:boolean,n:int>")
    pick = lambda *f: sorted(r["i"] for r in df.filter(condition(f)).collect())
    assert pick(MetadataFilter("b", "eq", True)) == [1] and pick(MetadataFilter("n", "eq", 3.0)) == [1]
    assert pick(MetadataFilter("f", "neq", "x")) == [1] and pick(MetadataFilter("f", "in", [])) == [] and pick(MetadataFilter("n", "exists")) == [1]
    assert condition() is None
    for bad in (MetadataFilter("a.b", "eq", 1), MetadataFilter("f", "like", 1)):
        with pytest.raises(ValueError):
            condition([bad])


def test_search_of_odd_vectors(spark):
    v = [[1.0, 0.0], [0.0, 0.0], None, [float("nan"), 1.0], [1.0], [2.0, 0.0], [0.0, 1.0]]
    df = spark.createDataFrame(list(enumerate(v)), "id int, embedding array<float>")
    assert [(r["id"], r["score"]) for r in search.top_k(df, [1.0, 0.0], 5).collect()] == [(0, 1.0), (5, 1.0), (6, 0.0)]


def test_batch_search_in_blocks(spark):
    v = [[1.0, 0.0], [0.0, 0.0], None, [float("nan"), 1.0], [1.0], [2.0, 0.0], [0.0, 1.0], [1.0, 1.0], [None, 1.0], []]
    df = spark.createDataFrame([(f"k{i}", x) for i, x in enumerate(v)], "id string, embedding array<float>")
    queries = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, 0.0])], "query_id int, query array<float>")
    for block in (1, 2, 100):
        got = [(r["query_id"], r["id"], round(r["score"], 6), r["rank"]) for r in search.batch_top_k(df, queries, 2, block=block).orderBy("query_id", "rank").collect()]
        assert got == [(1, "k0", 1.0, 1), (1, "k5", 1.0, 2), (2, "k6", 1.0, 1), (2, "k7", 0.707107, 2), (5, "k0", 1.0, 1), (5, "k5", 1.0, 2)]
    assert search.batch_top_k(df, queries.limit(0), 2).count() == 0 == search.batch_top_k(df.limit(0), queries, 2).count()


def test_lint_switches(spark):
    n = lint.nodes(spark.createDataFrame([("s", SHOP)], "path string, sdl string"))
    assert {r["rule"] for r in lint.lint(n, ["INPUT_TYPE_SUFFIX", lint.USAGE_RULES[0]]).collect()} == {"INPUT_TYPE_SUFFIX", lint.USAGE_RULES[0]}
    assert lint.lint(n, []).count() == 0
    assert len({r.name for r in lint.rules()} | set(lint.USAGE_RULES)) == 17


def script(**more):
    return ScriptedModel({"which operation type": "query", "reply with the id": more.get("pick", ""), "write the operation": more.get("first", "```graphql\n{ order(id: 1) { id } }\n```\n```json\n{\"id\": 1}\n```"), "has errors": more.get("fix", "```graphql\n{ order(id: 1) { id } }\n```")})


def test_generation(shop):
    model = script()
    g = Generator(shop.read(), HashingEmbedder(), model, SHOP)
    r = g.run("find an order by id")
    assert (r.operation_type, r.root_field, r.attempts, r.valid, r.variables) == ("query", "order", 1, True, {"id": 1})
    assert {d["name"] for d in r.documents} >= {"Order", "Buyer", "State"}
    assert [e[1] for e in g.events] == ["terms", "search", "type", "field", "types", "validate", "done"] and g.event_rows().count() == 7
    assert model.calls[-1]["temperature"] == 0.2 and "id (ID!)" in model.calls[-1]["messages"][-1]["content"]


def test_repair_loop(shop):
    bad = "```graphql\n{ order(id: 1) { nope } }\n```"
    model = script(first=bad)
    r = Generator(shop.read(), HashingEmbedder(), model, SHOP).run("order")
    assert (r.attempts, r.valid) == (2, True)
    said = [m["content"] for m in model.calls[-1]["messages"]]
    assert any(s.startswith("All fields of Order") for s in said)
    model = script(first=bad, fix=[bad])
    r = Generator(shop.read(), HashingEmbedder(), model, SHOP, EngineConfig(max_retries=4)).run("order")
    assert (r.attempts, r.valid) == (4, False) and [c["temperature"] for c in model.calls if "has errors" in c["messages"][-1]["content"]] == [0.1, 0.4, 0.4]


def test_generation_edges(shop, spark):
    g = Generator(shop.read().limit(0), HashingEmbedder(), script())
    with pytest.raises(LookupError):
        g.run("order")
    with pytest.raises(ValueError):
        g.run("  ")
    fallback = Generator(shop.read(), HashingEmbedder(), script(), SHOP).keyword_fallback("the order please")
    assert (fallback.operation_type, fallback.root_field) == ("query", "order")
    assert Generator(shop.read(), HashingEmbedder(), ScriptedModel({}), SHOP).terms("show me all the orders") == "orders"


@pytest.mark.parametrize("pick", ["exact", "part", "none", "empty"])
def test_choice_of_field(shop, pick):
    rows_ = [r.asDict() for r in shop.read().filter("type = 'field'").orderBy("id").limit(3).collect()]
    said = {"exact": rows_[1]["id"], "part": f"The id is {rows_[2]['id']}!", "none": "?!", "empty": ""}[pick]
    got = Generator(shop.read(), HashingEmbedder(), script(pick=said)).choose_field("x", rows_)
    assert got is rows_[{"exact": 1, "part": 2}.get(pick, 0)]


def test_answer_parsers():
    assert code_block("a ```graphql\n{ a }\n``` b ```graphql\n{ b }\n```", "graphql") == "{ a }"
    assert code_block("x ```\n{ c }\n```", "graphql") == "{ c }" and code_block(" { d } ", "graphql") == "{ d }"
    assert variables_of("```json\n{\"a\": 1}\n```") == {"a": 1} and variables_of("```json\n{a}\n```") == {} == variables_of("")
    assert [operation_kind(x) for x in ("A mutation", "SUBSCRIPTION", "dunno")] == ["Mutation", "Subscription", "Query"]
    assert unknown_fields(['Cannot query field "a" on type "T".', "Cannot query field 'b' on type 'T'", "else"]) == {"T": ["a", "b"]}
    assert read_validation("") == (True, []) == read_validation("Operation is valid")
    assert read_validation('{"valid": false, "errors": ["e"]}') == (False, ["e"])
    assert read_validation("Error: type `T` does not have a field `f`\nNote: path to the field: `a`\nError: other\nx") == (False, ['Cannot query field "f" on type "T".\nNote: path to the field: `a`', "other"])
    assert read_validation("just\n\nlines") == (False, ["just", "lines"])
    assert first_event("event: m\ndata: [DONE]\ndata: {\"a\":1}\n") == '{"a":1}'


def test_messages_and_requests():
    system, turns = merge_messages([{"role": "system", "content": "a"}, {"role": "assistant", "content": "b"}, {"role": "assistant", "content": "c"}, {"role": "system", "content": "d"}])
    assert system == "a\n\nd" and [t["role"] for t in turns] == ["user", "assistant"] and turns[1]["content"] == "b\n\nc"
    assert merge_messages([])[1] == [{"role": "user", "content": "Hello"}]
    for service in ("ollama", "ollama_cloud", "openai", "anthropic"):
        url, _, body = HttpModel(service, temperature=0.5, top_p=0.9).request([{"role": "user", "content": "x"}], 0.1)
        assert url.startswith("http") and json.dumps(body) and 0.1 in (body.get("temperature"), body.get("options", {}).get("temperature"))
    replies = [{"calls": [{"id": 1, "name": "f", "arguments": {"x": 1}}, {"id": 2, "name": "gone"}]}, {"text": "done"}]
    assert complete_with_tools(lambda m: replies.pop(0), [], {"f": lambda x: str(x)}) == "done"
    with pytest.raises(RuntimeError):
        complete_with_tools(lambda m: {"calls": [{"id": 1, "name": "f"}]}, [], {"f": lambda: ""}, 2)


def test_validators_accept_good_texts():
    assert validate_schema(SHOP) == []
    assert validate_operation("query A($id: ID!) { order(id: $id, state: OPEN) { ...F buyer { orders(first: 2) { id } } __typename } } fragment F on Order { state }", SHOP) == []
    assert validate_operation("mutation { place_order(input: {Note: \"x\", state: closed}) { id } }", SHOP) == []
    assert validate_operation("mutation { place_order(input: {Nope: 1}) { id } }", SHOP) and validate_operation("{ order(id: 1, state: GONE) { id } }", SHOP)


def test_analysis(shop):
    model = ScriptedModel({}, "# fine")
    r = analysis.analyse(shop.read(), model)
    assert r.markdown == "# fine" and "Query Design" in r.categories and r.document_count == shop.count()
    text = model.calls[0]["messages"][-1]["content"]
    assert "## Query fields" in text and "### Order" in text
    with pytest.raises(LookupError):
        analysis.analyse(shop.read().limit(0), model)


def test_file_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules").mkdir()
    for p, t in (("a/x.graphql", "type A {\n b: Int }"), ("a/blank.graphql", "  "), ("a/prose.graphql", "nothing here"), ("node_modules/y.graphql", "type C { d: Int }"), ("supergraph.yaml", "subgraphs: {}")):
        (tmp_path / p).write_text(t)
    found = files.sdl_files(spark, str(tmp_path))
    assert sorted(r["path"].rsplit("/")[-1] for r in found.collect()) == ["prose.graphql", "x.graphql"]
    assert files.schema_only(found).count() == 1 and files.discover(spark, str(tmp_path), "*.yaml").count() == 1
    designs = spark.createDataFrame([("federated", [(found.filter("path like '%x.graphql'").first()["path"],)])], "type string, subgraphs array<struct<schema_path:string>>")
    assert files.not_owned(found, designs).count() == 1


def test_introspection_source(spark, tmp_path):
    from sdlweave.plans.fixtures import INTROSPECTION

    (tmp_path / "i.json").write_text(json.dumps(INTROSPECTION))
    spark.dataSource.register(introspection.IntrospectionSource)
    got = spark.read.format("introspection").option("path", str(tmp_path / "i.json")).load().first()
    assert "type Root" in got["sdl"] and validate_schema(got["sdl"]) == []
    for status, body in ((500, "x"), (200, "<html>"), (200, '{"errors": [{"message": "no"}]}'), (200, '{"data": {}}')):
        with pytest.raises(ValueError):
            introspection.check(status, body)


def test_settings():
    c = EngineConfig().with_options(top_k=5, temperature=None)
    assert (c.top_k, c.temperature) == (5, 0.2)
    with pytest.raises(ValueError):
        c.with_options(nope=1)


def test_merge_turns_with_nulls(spark):
    t = spark.createDataFrame([(1, 1, "user", "a"), (1, 2, "user", None), (1, 3, None, "x"), (1, 4, None, "y"), (2, 1, "assistant", "z")], "conv_id int, turn int, role string, text string")
    m = rows.merge_turns(t)
    assert m.count() == 3
    same(rows.pad_first_user(m).filter("conv_id = 2").select("role").toPandas(), spark.createDataFrame([("user",), ("assistant",)], "role string").toPandas())
