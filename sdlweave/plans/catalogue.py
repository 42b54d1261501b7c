"""Registered queries of the reference operators over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sdlweave.functions import refs as Refs
from sdlweave.functions import text as X
from sdlweave.functions.similarity import cosine
from sdlweave.generation import analysis
from sdlweave.operators import designs as D
from sdlweave.operators import graph, ivf, rows, search
from sdlweave.operators.collection import filled_namespaces
from sdlweave.operators.predicates import ColumnFilter, MetadataFilter, apply
from sdlweave.runtime import table
from sdlweave.streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.strip()
        return f

    return add


# -- vector search ------------------------------------------------------------------------------
Q = [((i * 37 % 19) - 9) / 10 for i in range(64)]
_Q = "[" + ", ".join(f"{x}::double" for x in Q) + "]"
_VEC = "list_transform(embedding, lambda x: x::double)"
_SCORED = f"s as (select vec_id, label, list_cosine_similarity({_VEC}, {_Q}) as score from embeddings)"
_OK = "embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64 and len(list_filter(embedding, lambda x: x <> 0)) > 0"
_STORED = f"s as (select stored_id, type, name, collection, metadata, list_cosine_similarity({_VEC}, {_Q}) as score from stored_documents where {_OK})"


def _round(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.round("score", 6).alias("score"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


@query(f"with {_SCORED} select vec_id, label, round(score, 6) as score from s order by s.score desc, vec_id limit 10")
def topk_cosine(spark, d):
    return _round(search.top_k(_vectors(spark, d), Q, key="vec_id"), "vec_id", "label")


@query(f"with {_SCORED} select vec_id, label, round(score, 6) as score from s where label = 3 order by s.score desc, vec_id limit 10")
def topk_filtered(spark, d):
    return _round(search.top_k(_vectors(spark, d), Q, columns=[ColumnFilter("label", "eq", 3)], key="vec_id"), "vec_id", "label")


@query(f"with {_SCORED}, k as (select * from s order by score desc, vec_id limit 50) select vec_id, label, round(score, 6) as score from k where score >= 0.2")
def topk_threshold(spark, d):
    return _round(search.above(search.top_k(_vectors(spark, d), Q, 50, key="vec_id"), 0.2), "vec_id", "label")


@query(f"with {_SCORED} select vec_id, label, round(score, 6) as score from s where label in (1, 4, 7) order by s.score desc, vec_id limit 25")
def topk_in_filter(spark, d):
    return _round(search.top_k(_vectors(spark, d), Q, 25, columns=[ColumnFilter("label", "in", [1, 4, 7])], key="vec_id"), "vec_id", "label")


@query(f"with {_SCORED}, k as (select * from s order by score desc, vec_id limit 50) select vec_id, label, round(score, 6) as score from k where label = 2 order by k.score desc, vec_id limit 10")
def over_fetch_trim(spark, d):
    return _round(search.over_fetch(_vectors(spark, d), Q, 10, F.col("label") == 2, key="vec_id"), "vec_id", "label")


@query(f"""with {_SCORED}, k as (select * from s order by score desc, vec_id limit 50),
t as (select max(t) as threshold from (values (0.4), (0.35), (0.3), (0.25), (0.2), (0.15), (0.1), (0.05), (0.0)) l(t) where t <= (select max(score) from k))
select vec_id, label, round(score, 6) as score, cast(threshold as double) as threshold from k, t where score >= threshold""")
def threshold_ladder(spark, d):
    got = search.ladder(search.top_k(_vectors(spark, d), Q, 50, key="vec_id"))
    return got.select("vec_id", "label", F.round("score", 6).alias("score"), "threshold")


@query(f"""with q as (select vec_id as query_id, {_VEC} as qv from embeddings where vec_id % 100 = 0),
p as (select query_id, vec_id, list_cosine_similarity({_VEC}, qv) as score from embeddings, q)
select query_id, vec_id, round(score, 6) as score, cast(row_number() over (partition by query_id order by p.score desc, vec_id) as integer) as rank from p qualify rank <= 5""")
def batch_topk(spark, d):
    v = _vectors(spark, d)
    queries = v.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.batch_top_k(v, queries, 5, key="vec_id").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"with {_SCORED} select round(min(score), 6) as min_score, round(max(score), 6) as max_score from s")
def score_range(spark, d):
    r = search.score_range(search.scored(_vectors(spark, d), Q))
    return r.select(F.round("min_score", 6).alias("min_score"), F.round("max_score", 6).alias("max_score"))


@query(f"""with {_STORED} select stored_id, name, round(score, 6) as score from s where metadata.parentType in ('Query', 'Mutation', 'Subscription') order by s.score desc, stored_id limit 50""")
def root_field_search(spark, d):
    """Root fields among stored documents; vectors that cannot be compared are left out."""
    docs = table(spark, d, "stored_documents")
    got = search.root_fields(docs, Q, threshold=-2.0, key="stored_id")
    return _round(got, "stored_id", "name")


@query(f"with {_STORED} select stored_id, type, round(score, 6) as score from s where metadata.kind = 'FieldDefinition' and metadata.fieldType <> 'String' and type = 'field' order by s.score desc, stored_id limit 20")
def topk_metadata(spark, d):
    got = search.top_k(table(spark, d, "stored_documents"), Q, 20, [MetadataFilter("kind", "eq", "FieldDefinition"), MetadataFilter("fieldType", "neq", "String")], [ColumnFilter("type", "eq", "field")], key="stored_id")
    return _round(got, "stored_id", "type")


@query(f"with {_SCORED}, k as (select * from s order by score desc, vec_id limit 10) select vec_id, round(score, 6) as score from k order by case when vec_id::varchar = '7' then 0 when contains('7', vec_id::varchar) or contains(vec_id::varchar, '7') then 1 else 2 end, k.score desc, vec_id::varchar limit 1")
def answer_pick(spark, d):
    best = search.top_k(_vectors(spark, d), Q, key="vec_id").withColumn("id", F.col("vec_id").cast("string"))
    return search.pick_answer(best, "7").select("vec_id", F.round("score", 6).alias("score"))


@query(f"with {_SCORED} select vec_id, round(score, 6) as score from s order by s.score desc, vec_id limit 10")
def ivf_all_probes(spark, d):
    """The inverted lists with all of them probed give the exact answer."""
    v = _vectors(spark, d)
    c = ivf.fit(v, 16, key="vec_id")
    return _round(ivf.probe(ivf.assign(v, c), c, Q, 10, len(c), key="vec_id"), "vec_id")


@query("select count(*) as queries, true as reached from embeddings where vec_id % 100 = 0")
def ivf_recall(spark, d):
    """Stated queries on 100 lists with as many probes as the calibration gives: whether at least 0.9 of the true ten nearest are found."""
    v = _vectors(spark, d).select("vec_id", "embedding")
    centroids, probes = ivf.fit_calibrated(v, 100, 0.95, key="vec_id")
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    exact = search.batch_top_k(v, asked, 10, key="vec_id")
    found = search.batch_top_k(ivf.assign(v, centroids), asked, 10, key="vec_id", lists=(centroids, probes))
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), (F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count(F.lit(1))).alias("reached"))


@query(f"with q as (select {_VEC} as e from embeddings where vec_id = 0) select vec_id, round(list_cosine_similarity({_VEC}, q.e), 6) as score from embeddings, q where list_cosine_similarity({_VEC}, q.e) >= 0.5")
def near_one(spark, d):
    v = _vectors(spark, d)
    one = F.broadcast(v.filter("vec_id = 0").select(F.col("embedding").alias("e")).limit(1))
    return v.join(one).select("vec_id", cosine(F.col("embedding"), F.col("e")).alias("score")).filter("score >= 0.5").select("vec_id", F.round("score", 6).alias("score"))


@query(f"""with {_SCORED}, k as (select vec_id, score from s order by score desc, vec_id limit 10)
select vec_id, round(score, 6) as score from k union all select vec_id, 1.0 from embeddings where label = 5""")
def union_relevant(spark, d):
    v = _vectors(spark, d)
    top = search.top_k(v, Q, key="vec_id").select("vec_id", "score")
    return _round(top.unionByName(v.filter("label = 5").select("vec_id", F.lit(1.0).alias("score"))), "vec_id")


# -- predicates ---------------------------------------------------------------------------------
def _docs(spark, d):
    return table(spark, d, "embedding_documents")


def _meta(*filters: MetadataFilter):
    return lambda spark, d: apply(_docs(spark, d), filters).select("row_id", "name")


for _name, _filters, _where in (
    ("meta_eq", [MetadataFilter("fieldType", "eq", "String")], "metadata.fieldType = 'String'"),
    ("meta_eq_boolean", [MetadataFilter("isRootOperationField", "eq", True)], "metadata.isRootOperationField"),
    ("meta_eq_number", [MetadataFilter("chunkIndex", "eq", 1)], "metadata.chunkIndex = 1"),
    ("meta_neq", [MetadataFilter("fieldType", "neq", "String")], "metadata.fieldType <> 'String'"),
    ("meta_in", [MetadataFilter("parentType", "in", ["Query", "Mutation"])], "metadata.parentType in ('Query', 'Mutation')"),
    ("meta_in_empty", [MetadataFilter("parentType", "in", [])], "false"),
    ("meta_exists", [MetadataFilter("enumValues", "exists")], "metadata.enumValues is not null"),
    ("meta_conjunction", [MetadataFilter("kind", "eq", "FieldDefinition"), MetadataFilter("parentType", "exists")], "metadata.kind = 'FieldDefinition' and metadata.parentType is not null"),
):
    QUERIES[_name] = _meta(*_filters)
    SQL[_name] = f"select row_id, name from embedding_documents where {_where}"


def _json(f: MetadataFilter):
    return lambda spark, d: apply(table(spark, d, "events"), [f], source="props", as_json=True).select("event_id", "event_type")


for _name, _filter, _where in (
    ("json_eq", MetadataFilter("k", "eq", 69), "props->>'$.k' = '69'"),
    ("json_neq", MetadataFilter("k", "neq", 69), "props->>'$.k' <> '69'"),
    ("json_in", MetadataFilter("k", "in", [1, 2, 3]), "props->>'$.k' in ('1', '2', '3')"),
    ("json_exists", MetadataFilter("k", "exists"), "json_exists(props, '$.k')"),
):
    QUERIES[_name] = _json(_filter)
    SQL[_name] = f"select event_id, event_type from events where {_where}"


@query("select row_id, type, name from embedding_documents where type in ('union', 'scalar') and name is not null")
def column_in(spark, d):
    return apply(_docs(spark, d), columns=[ColumnFilter("type", "in", ["union", "scalar"])]).select("row_id", "type", "name")


@query("select row_id, name, content from embedding_documents where type = 'enum' order by collection, name, row_id limit 25")
def exact_lookup(spark, d):
    return search.lookup(_docs(spark, d), columns=[ColumnFilter("type", "eq", "enum")], order=["collection", "name", "row_id"], limit=25).select("row_id", "name", "content")


# -- counting and grouping ----------------------------------------------------------------------
@query("select type, count(*) as n from embedding_documents group by type")
def type_histogram(spark, d):
    return _docs(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) as n from stored_documents")
def collection_count(spark, d):
    return table(spark, d, "stored_documents").agg(F.count(F.lit(1)).alias("n"))


@query("select collection, count(*) as n from stored_documents group by collection")
def namespace_list(spark, d):
    return filled_namespaces(table(spark, d, "stored_documents"))


@query("""select collection, coalesce(metadata.parentType, 'Unknown') as parent, count(*) as n, string_agg(content, chr(10) order by row_id) as body
from embedding_documents where type = 'field' group by all""")
def fields_by_parent(spark, d):
    return rows.group_fields(_docs(spark, d).filter("type = 'field'"), F.col("metadata.parentType"), "row_id", "content", ["collection"])


_CATEGORY = "case when type = 'field' then case when metadata.parentType in ('Query', 'Mutation', 'Subscription') then lower(metadata.parentType) else 'field' end else 'type' end"


@query(f"select {_CATEGORY} as category, count(*) as n, least(count(*), 500) as taken from embedding_documents group by 1")
def category_counts(spark, d):
    return analysis.counts(_docs(spark, d))


@query(f"select category, row_id from (select row_id, {_CATEGORY} as category from embedding_documents) qualify row_number() over (partition by category order by row_id) <= 500")
def category_limit(spark, d):
    return search.limit_per(analysis.categorised(_docs(spark, d)), "category", ["row_id"]).select("category", "row_id")


@query("select p_brand as category, p_partkey from part qualify row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) <= 5")
def limit_per_brand(spark, d):
    return search.limit_per(table(spark, d, "part"), "p_brand", [F.desc("p_retailprice"), "p_partkey"], 5).select(F.col("p_brand").alias("category"), "p_partkey")


@query("""with e as (select 'Cannot query field "' || name || '" on type "' || metadata.parentType || '".' as m from embedding_documents where type = 'field')
select regexp_extract(m, 'on type "(\\w+)"', 1) as type, count(distinct regexp_extract(m, 'field "(\\w+)"', 1)) as n_fields, list_sort(list(distinct regexp_extract(m, 'field "(\\w+)"', 1))) as fields
from e where regexp_matches(m, 'field "\\w+" on type "\\w+"') group by 1""")
def missing_fields_by_type(spark, d):
    message = F.concat(F.lit('Cannot query field "'), "name", F.lit('" on type "'), "metadata.parentType", F.lit('".'))
    named = _docs(spark, d).filter("type = 'field'").select(X.missing_field(message).alias("m")).select("m.*").filter("field is not null")
    return named.groupBy("type").agg(F.countDistinct("field").alias("n_fields"), F.array_sort(F.collect_set("field")).alias("fields"))


# -- dedup, difference, upsert ------------------------------------------------------------------
@query("select collection, id, row_id from embedding_documents qualify row_number() over (partition by collection, id order by row_id desc) = 1")
def dedup_last_wins(spark, d):
    return rows.keep_last(_docs(spark, d), ["collection", "id"], ["row_id"]).select("collection", "id", "row_id")


@query("select collection, type, name, row_id from embedding_documents qualify row_number() over (partition by collection, type, name order by loaded_at, row_id) = 1")
def dedup_first_wins(spark, d):
    return rows.keep_first(_docs(spark, d), ["collection", "type", "name"], ["loaded_at", "row_id"]).select("collection", "type", "name", "row_id")


def _halves(spark, d):
    """Contents loaded before and since a date, one row a content id."""
    docs = rows.keep_last(_docs(spark, d).withColumn("new", F.col("loaded_at") >= F.lit("2024-07-01").cast("timestamp")), ["new", "id"], ["row_id"]).select("new", "id", "row_id")
    return docs.filter("new").drop("new"), docs.filter("not new").drop("new")


_HALVES = """h as (select id, row_id, loaded_at >= timestamptz '2024-07-01 00:00:00+00' as n from embedding_documents
  qualify row_number() over (partition by loaded_at >= timestamptz '2024-07-01 00:00:00+00', id order by row_id desc) = 1)"""


@query(f"with {_HALVES} select id, row_id from h where n and id not in (select id from h where not n)")
def diff_added(spark, d):
    return rows.added(*_halves(spark, d))


@query(f"with {_HALVES} select id, row_id from h where not n and id not in (select id from h where n)")
def diff_deleted(spark, d):
    return rows.removed(*_halves(spark, d))


@query(f"with {_HALVES} select id, row_id from h where n and id in (select id from h where not n)")
def diff_unchanged(spark, d):
    return rows.unchanged(*_halves(spark, d))


@query("""with n as (select o_orderkey, o_custkey + 1 as o_custkey, o_orderstatus, 1 as src from orders where o_orderdate >= timestamp '1996-01-01'),
b as (select o_orderkey, o_custkey, o_orderstatus, 0 as src from orders where o_orderdate < timestamp '1997-01-01' union all select * from n)
select o_orderkey, o_custkey, o_orderstatus from b qualify row_number() over (partition by o_orderkey order by src desc) = 1""")
def upsert_merge(spark, d):
    """Orders before 1997, with those since 1996 loaded again."""
    o = table(spark, d, "orders")
    cols = ["o_orderkey", "o_custkey", "o_orderstatus"]
    old, new = o.filter("o_orderdate < timestamp_ntz'1997-01-01'").select(cols), o.filter("o_orderdate >= timestamp_ntz'1996-01-01'").select(cols)
    return rows.upsert(old, new.withColumn("o_custkey", F.col("o_custkey") + 1), "o_orderkey")


@query("select row_id, collection, name from embedding_documents e where type <> 'field' and not exists (select 1 from removals r where r.collection = e.collection and r.type_name = e.name)")
def delete_by_keys(spark, d):
    gone = table(spark, d, "removals").select("collection", F.col("type_name").alias("name")).distinct()
    return rows.delete_by_keys(_docs(spark, d).filter("type <> 'field'"), gone, ["collection", "name"]).select("row_id", "collection", "name")


@query("""with c as (select collection, type, name, metadata.chunkIndex as i, max(metadata.totalChunks) over (partition by collection, type, name) as t from embedding_documents where metadata.chunkIndex is not null)
select collection, type, name, count(distinct i) as n_chunks, count(distinct i) = max(t) as complete from c group by all""")
def chunk_completeness(spark, d):
    return rows.merge_chunks(_docs(spark, d)).select("collection", "type", "name", "n_chunks", "complete")


@query("""with k as (select collection, type, name, metadata.chunkIndex as i, content,
  regexp_extract(content, '^(?:\"\"\"(?:[^\"]|\"[^\"]|\"\"[^\"])*\"\"\"|\"(?:[^\"\\\\]|\\\\.)*\"|[^{\"])*\\{') as h from embedding_documents where metadata.chunkIndex is not null
  qualify row_number() over (partition by collection, type, name, metadata.chunkIndex order by id) = 1)
select collection, type, name, first(h order by i) || string_agg(substr(content, length(h) + 1, length(content) - length(h) - 1), '' order by i) || '}' as content from k group by all""")
def chunk_merge(spark, d):
    return rows.merge_chunks(_docs(spark, d)).select("collection", "type", "name", "content")


# -- expressions --------------------------------------------------------------------------------
_UNITS = "flatten(list_transform(string_split(content, ''), lambda c: case when ord(c) > 65535 then [(55296 + ((ord(c) - 65536) // 1024))::bigint, (56320 + ((ord(c) - 65536) % 1024))::bigint] else [ord(c)::bigint] end))"


@query(f"""select row_id, case when content = '' then '0' else lower(to_base(abs(list_reduce(list_prepend(0::bigint, {_UNITS}), lambda h, c: ((31 * h + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)), 36)) end as content_id from embedding_documents""")
def content_hash_id(spark, d):
    return _docs(spark, d).select("row_id", X.content_id(F.col("content")).alias("content_id"))


@query("""select row_id, regexp_matches(name, '^_*[a-z][a-zA-Z0-9]*$') as camel, regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$') as pascal,
regexp_matches(name, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$') as screaming, regexp_extract(name, '^(get|list|post|put|patch)[A-Z]', 1) as verb from embedding_documents""")
def naming_rules(spark, d):
    n = F.col("name")
    return _docs(spark, d).select("row_id", X.is_camel(n).alias("camel"), X.is_pascal(n).alias("pascal"), X.is_screaming(n).alias("screaming"), X.rest_verb(n).alias("verb"))


@query("""select row_id, v as value from (select row_id, unnest(metadata.enumValues) as v from embedding_documents) where v is not null and not regexp_matches(v, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$')""")
def enum_values_not_screaming(spark, d):
    return _docs(spark, d).select("row_id", F.explode("metadata.enumValues").alias("value")).filter(~X.is_screaming(F.col("value")))


@query(r"select row_id, regexp_replace(translate(metadata.fieldType, '[]!', ''), '^\s+|\s+$', '', 'g') as base from embedding_documents where type = 'field'")
def base_type_strip(spark, d):
    return _docs(spark, d).filter("type = 'field'").select("row_id", Refs.base_type(F.col("metadata.fieldType")).alias("base"))


@query("select row_id, list_transform(list_filter(metadata.arguments, lambda a: a is not null and trim(a.type) like '%!'), lambda a: a.name) as required from embedding_documents where metadata.arguments is not null")
def required_args(spark, d):
    return _docs(spark, d).filter("metadata.arguments is not null").select("row_id", F.transform(Refs.required_arguments(F.col("metadata.arguments")), lambda a: a["name"]).alias("required"))


@query("""select distinct config_path, case when n = '' then 'embeddings' else n || '_embeddings' end as table_name
from (select config_path, regexp_replace(regexp_replace(lower(config_path), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as n from designs)""")
def table_name_sanitise(spark, d):
    return table(spark, d, "designs").select("config_path", X.table_name(F.col("config_path")).alias("table_name")).distinct()


@query("select c_custkey, regexp_matches(c_name, '^[a-zA-Z_][a-zA-Z0-9_]*$') as valid from customer")
def table_name_valid(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.valid_table_name(F.col("c_name")).alias("valid"))


@query("select doc_id, substring(text, 1, 120) as preview from documents")
def previews(spark, d):
    return table(spark, d, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query(f"with {_SCORED} select vec_id, case when score >= 0.7 then 'high' when score >= 0.5 then 'medium' else 'low' end as bucket, cast(greatest(10, floor(score * 80 + 0.5)) as integer) as bar from s")
def score_buckets(spark, d):
    s = search.scored(_vectors(spark, d), Q)
    return s.select("vec_id", X.score_bucket(F.col("score")).alias("bucket"), X.score_bar(F.col("score")).alias("bar"))


@query(r"select row_id, regexp_replace(content, '^\s+|\s+$', '', 'g') as code from embedding_documents where content <> ''")
def code_block_extract(spark, d):
    answer = F.concat(F.lit("Here it is:\n```graphql\n"), "content", F.lit("\n```\nand\n```json\n{}\n```"))
    return _docs(spark, d).filter("content <> ''").select("row_id", X.code_block(answer, "graphql").alias("code"))


@query("select batch_id, case when payload is not null and json_valid(payload) then regexp_replace(payload, '^\\s+|\\s+$', '', 'g') else '{}' end as variables from raw_batches")
def json_variables(spark, d):
    answer = F.concat(F.lit("```json\n"), F.coalesce("payload", F.lit("?")), F.lit("\n```"))
    return table(spark, d, "raw_batches").select("batch_id", F.when(F.col("payload").isNotNull(), X.json_variables(answer)).otherwise("{}").alias("variables"))


@query("select 'k' || (event_id % 7)::varchar as k, 'a|' || (event_id % 3)::varchar || '|z' as error_key, count(*) as n from events group by all")
def error_keys(spark, d):
    e = table(spark, d, "events")
    errors = F.array(F.lit("z"), (F.col("event_id") % 3).cast("string"), F.lit("a"))
    key = F.concat_ws("|", F.element_at(F.split(X.error_key(errors), r"\|"), 2), F.element_at(F.split(X.error_key(errors), r"\|"), 1), F.element_at(F.split(X.error_key(errors), r"\|"), 3))
    return e.groupBy(F.concat(F.lit("k"), (F.col("event_id") % 7).cast("string")).alias("k"), key.alias("error_key")).agg(F.count(F.lit(1)).alias("n"))


@query("""with m as (select event_id, event_id * 7 as ms from events), t as (select *, ((ms % 60000 + 50) // 100) as tenths, ((ms + 50) // 100) as all_tenths from m)
select event_id, case when ms < 1000 then ms::varchar || 'ms' when ms < 60000 then (all_tenths // 10)::varchar || '.' || (all_tenths % 10)::varchar || 's'
  else (ms // 60000)::varchar || 'm ' || (tenths // 10)::varchar || '.' || (tenths % 10)::varchar || 's' end as duration from t""")
def durations(spark, d):
    return table(spark, d, "events").select("event_id", X.duration(F.col("event_id") * 7).alias("duration"))


@query("select design_id, case when regexp_matches(u, '^https?://') then u else 'https://' || u end as endpoint from (select design_id, regexp_replace(trim(unnest(subgraphs).routing_url), '/+$', '') as u from designs) where u is not null")
def endpoints(spark, d):
    s = table(spark, d, "designs").select("design_id", F.explode("subgraphs").alias("s")).filter("s.routing_url is not null")
    return s.select("design_id", X.endpoint(F.col("s.routing_url")).alias("endpoint"))


_FILLER = "[" + ", ".join(f"'{w}'" for w in X.FILLER) + "]"


@query(rf"select row_id, coalesce(nullif(array_to_string(list_filter(regexp_split_to_array(trim(description), '\s+'), lambda w: not list_contains({_FILLER}, lower(w))), ' '), ''), description) as terms from embedding_documents where description is not null")
def search_terms(spark, d):
    return _docs(spark, d).filter("description is not null").select("row_id", X.search_terms(F.col("description")).alias("terms"))


@query(r"""with t as (select row_id, length(content) as n, len(regexp_extract_all(content, '[0-9A-Za-z_]+|[^0-9A-Za-z_\s]')) as tokens from embedding_documents)
select row_id, cast(tokens as integer) as tokens, cast(floor(256 * (n::double / tokens) * 0.9) as integer) as safe_chars, case when tokens <= 256 then 'embed' else 'chunk' end as route from t""")
def token_route(spark, d):
    return rows.route(_docs(spark, d), X.token_count(F.col("content")), 256).select("row_id", "tokens", "safe_chars", "route")


@query("""select o_orderkey, '# Prompt: ' || o_orderstatus || chr(10) || o_orderpriority as text, case when contains(lower(o_orderpriority), 'mutation') then 'Mutation' else 'Query' end as op from orders""")
def prompt_headers(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", X.prompt_header(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("text"), X.operation_type(F.col("o_orderpriority")).alias("op"))


# -- chat turns: users' events stand in for conversations -----------------------------------------
def _turns(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.when(F.col("event_id") % 5 == 0, "system").when(F.col("event_id") % 3 == 0, "assistant").otherwise("user").alias("role"), F.col("props").alias("text"))


_TURNS = "t as (select user_id as conv_id, event_id as turn, case when event_id % 5 = 0 then 'system' when event_id % 3 = 0 then 'assistant' else 'user' end as role, props as text from events)"
_MERGED = f"""{_TURNS},
f as (select *, case when lag(role) over (partition by conv_id order by turn) is not distinct from role then 0 else 1 end as new from t where role <> 'system'),
g as (select *, sum(new) over (partition by conv_id order by turn) as island from f),
m as (select conv_id, cast(island as bigint) as island, role, string_agg(text, chr(10) || chr(10) order by turn) as text, min(turn) as first_turn from g group by conv_id, island, role)"""


@query(f"with {_MERGED} select * from m")
def role_merge(spark, d):
    return rows.merge_turns(_turns(spark, d).filter("role <> 'system'"))


@query(f"with {_TURNS} select conv_id, string_agg(text, chr(10) || chr(10) order by turn) as system from t where role = 'system' group by conv_id")
def system_fold(spark, d):
    return rows.fold_system(_turns(spark, d))


@query(f"""with {_MERGED}, h as (select * from m qualify row_number() over (partition by conv_id order by first_turn) = 1)
select * from m union all select conv_id, island - 1, 'user', 'Continue.', first_turn - 1 from h where role <> 'user'""")
def first_user_pad(spark, d):
    return rows.pad_first_user(rows.merge_turns(_turns(spark, d).filter("role <> 'system'")))


# -- graphs -------------------------------------------------------------------------------------
def _key_graph(spark, d):
    t = lambda n: table(spark, d, n)
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    n = t("nation").select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
    c = t("customer").select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst"))
    o = t("orders").select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"))
    return n.union(c).union(o)


_KEYS = """e as (select 'r' || n_regionkey as src, 'n' || n_nationkey as dst from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer union all select 'c' || o_custkey, 'o' || o_orderkey from orders)"""


@query(f"with recursive {_KEYS}, r as (select 'r1' as node, 0 as depth union select e.dst, r.depth + 1 from r join e on e.src = r.node where r.depth < 10) select node, min(depth) as depth from r group by node")
def bfs_reachability(spark, d):
    return graph.bfs(_key_graph(spark, d), spark.createDataFrame([("r1",)], "node string"), None)


@query(f"with recursive {_KEYS}, r as (select 'r1' as node, 0 as depth union select e.dst, r.depth + 1 from r join e on e.src = r.node where r.depth < 2) select node, min(depth) as depth from r group by node")
def bfs_depth_capped(spark, d):
    return graph.bfs(_key_graph(spark, d), spark.createDataFrame([("r1",)], "node string"), 2)


_BASE = r"regexp_replace(translate({}, '[]!', ''), '^\s+|\s+$', '', 'g')"
_EDGES = f"""g as (
  select distinct collection, src, dst, kind from (
    select collection, metadata.parentType as src, {_BASE.format('metadata.fieldType')} as dst, 'field' as kind from embedding_documents where type = 'field'
    union all select collection, name, unnest(metadata.possibleTypes), 'member' from embedding_documents
    union all select collection, name, unnest(metadata.interfaces), 'interface' from embedding_documents)
  where src is not null and dst is not null and dst not in ('ID', 'String', 'Int', 'Float', 'Boolean'))"""


@query(f"with {_EDGES} select * from g")
def type_edges(spark, d):
    return graph.edges(_docs(spark, d))


@query(f"""with recursive {_EDGES},
seed as (select distinct collection, b as node from (
  select collection, {_BASE.format('metadata.fieldType')} as b from embedding_documents where metadata.isRootOperationField
  union all select collection, {_BASE.format('a.type')} from (select collection, unnest(metadata.arguments) as a from embedding_documents where metadata.isRootOperationField))
  where b is not null and b not in ('ID', 'String', 'Int', 'Float', 'Boolean')),
r as (select collection, node, 1 as depth from seed union select g.collection, g.dst, r.depth + 1 from r join g on g.collection = r.collection and g.src = r.node where r.depth < 5),
m as (select collection, node, min(depth) as depth from r group by all)
select e.row_id, e.collection, e.name, m.depth from embedding_documents e join m on m.collection = e.collection and m.node = e.name where e.type <> 'field'""")
def related_types(spark, d):
    docs = _docs(spark, d)
    return graph.related_types(docs, docs.filter("metadata.isRootOperationField")).select("row_id", "collection", "name", "depth")


# -- joins over designs -------------------------------------------------------------------------
_NAME = r"coalesce(nullif(regexp_extract(config_path, '([^/]+)/supergraph\.ya?ml$', 1), ''), regexp_extract(config_path, '([^/]+?)(?:\.[^./]+)?$', 1))"
_TABLED = rf"""t as (select *, coalesce(embedding_table, case when regexp_replace(regexp_replace(lower({_NAME}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') = '' then 'embeddings' else regexp_replace(regexp_replace(lower({_NAME}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '_embeddings' end) as table_name from designs)"""


@query(f"with {_TABLED} select design_id, table_name, table_name in (select collection from embedding_documents) as is_embedded from t")
def design_state(spark, d):
    tables = _docs(spark, d).select(F.col("collection").alias("table_name"))
    return D.restore_state(table(spark, d, "designs"), tables).select("design_id", "table_name", "is_embedded")


@query(f"with {_TABLED} select distinct config_path, table_name from t where is_embedded")
def embedding_state(spark, d):
    return D.embedding_state(table(spark, d, "designs"))


@query("""select s.schema_path as path, design_id, s.name as subgraph_name from (select design_id, unnest(subgraphs) as s from designs) where s.schema_path is not null
union all select config_path, design_id, null from designs where type = 'standalone' and config_path is not null""")
def file_owners(spark, d):
    return D.file_owners(table(spark, d, "designs"))


@query(f"with {_TABLED} select distinct config_path, table_name from t where is_embedded and config_path not in (select config_path from designs where type = 'standalone')")
def deleted_designs(spark, d):
    ds = table(spark, d, "designs")
    return D.deleted_designs(D.embedding_state(ds), ds.filter("type = 'standalone'"))


@query(f"with {_TABLED} select table_name, design_id, 'http://localhost:' || (9000 + design_id)::varchar as url from t")
def service_of_table(spark, d):
    ds = table(spark, d, "designs")
    services = ds.select("design_id", F.concat(F.lit("http://localhost:"), (F.col("design_id") + 9000).cast("string")).alias("url"))
    return D.service_of_table(ds, services)


@query("select s_suppkey, s_name, coalesce(n_name, 'ID!') as type from supplier left join (select * from nation where n_regionkey <> 2) on s_nationkey = n_nationkey")
def left_join_default(spark, d):
    n = table(spark, d, "nation").filter("n_regionkey <> 2")
    return table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "s_name", F.coalesce("n_name", F.lit("ID!")).alias("type"))


@query("""with u as (select collection, 'input' as usage, unnest(metadata.arguments).type as t from embedding_documents union all select collection, 'output', metadata.fieldType from embedding_documents where type = 'field'),
b as (select distinct collection, usage, regexp_replace(translate(t, '[]!', ''), '^\\s+|\\s+$', '', 'g') as name from u)
select e.row_id, e.name, b.usage from embedding_documents e join b on b.collection = e.collection and b.name = e.name where e.type = 'enum'""")
def enum_usage(spark, d):
    docs = _docs(spark, d)
    args = docs.select("collection", F.lit("input").alias("usage"), F.explode("metadata.arguments").alias("a")).select("collection", "usage", Refs.base_type(F.col("a.type")).alias("name"))
    fields = docs.filter("type = 'field'").select("collection", F.lit("output").alias("usage"), Refs.base_type(F.col("metadata.fieldType")).alias("name"))
    return docs.filter("type = 'enum'").join(args.union(fields).distinct(), ["collection", "name"]).select("row_id", "name", "usage")


# -- events: bursts and windows, in batch -------------------------------------------------------
def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""with f as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 1 hour then 0 else 1 end as new from events),
g as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as i from f)
select user_id, min(ts) as burst_start, max(ts) + interval 1 hour as burst_end, count(*) as n from g group by user_id, i""")
def debounce_bursts(spark, d):
    b = jobs.bursts(_events(spark, d), gap="1 hour")
    return b.select("user_id", F.col("burst_start").cast("timestamp_ntz").alias("burst_start"), F.col("burst_end").cast("timestamp_ntz").alias("burst_end"), "n")


@query("select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_per_key(spark, d):
    return rows.keep_last(_events(spark, d), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("select time_bucket(interval 1 hour, ts, timestamp '1970-01-01') as window_start, event_type, count(*) as n from events group by all")
def tumbling_counts(spark, d):
    w = jobs.tumbling(_events(spark, d))
    return w.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""select window_start, event_type, count(*) as n from (
  select time_bucket(interval 30 minutes, ts, timestamp '1970-01-01') - to_minutes(30 * unnest([0, 1])) as window_start, event_type from events) group by all""")
def sliding_counts(spark, d):
    w = jobs.sliding(_events(spark, d))
    return w.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


