"""Registered queries of the general problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sdlweave.operators import hierarchy as H
from sdlweave.operators import references as R
from sdlweave.runtime import spread, table
from sdlweave.sources import nested as N


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(table(spark, d, n) for n in ("embedding_documents", "removals", "builtin_types"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return R.orphan_references(*_sides(spark, d)).select("row_id", "ref_field", "ref_name", "status")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return R.orphan_report(*_sides(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchy(table(spark, d, "embedding_documents")).select("collection", "type_name", "root_name", "depth", "on_cycle")


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    tree = H.paths(table(spark, d, "embedding_documents")).filter("depth >= 0")
    return tree.select("collection", "type_name", "root_name", "depth", "parent_name", "path", F.col("subtree_size").cast("long").alias("subtree_size"))


def p6_chains(spark: SparkSession, d: str) -> DataFrame:
    """The heavy-path labels: nodes of a chain have neighbouring positions, a subtree is an interval of them."""
    return H.hierarchy(table(spark, d, "embedding_documents")).select("collection", "type_name", "root_name", "chain", "pos", "subtree_size")


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """The descendants within the breadth-first forest."""
    return H.descendants(H.hierarchy(table(spark, d, "embedding_documents")))


def p6_all_descendants(spark: SparkSession, d: str) -> DataFrame:
    """The descendants over all links."""
    return H.all_descendants(table(spark, d, "embedding_documents"))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "raw_batches"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return N.list_items(_raw(spark, d))


def p3_batches(spark: SparkSession, d: str) -> DataFrame:
    return N.batches_table(_raw(spark, d))


def p3_subgraphs(spark: SparkSession, d: str) -> DataFrame:
    return N.subgraphs_table(_raw(spark, d))


def p3_documents(spark: SparkSession, d: str) -> DataFrame:
    return N.documents_table(_raw(spark, d))


def p3_arguments(spark: SparkSession, d: str) -> DataFrame:
    return N.arguments_table(_raw(spark, d))


def p3_argument_properties(spark: SparkSession, d: str) -> DataFrame:
    """Everything else that an argument holds outside further lists."""
    return N.argument_properties(_raw(spark, d))


def p3_directives(spark: SparkSession, d: str) -> DataFrame:
    return N.directives_table(_raw(spark, d))


def p3_directive_arguments(spark: SparkSession, d: str) -> DataFrame:
    return N.directive_arguments(_raw(spark, d))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """The repeated ancestors that occur, with the paths below them."""
    return N.groups(N.triples(_raw(spark, d)))


def _tagged(name: str) -> Column:
    return F.transform(F.col(f"metadata.{name}"), lambda x, i: F.struct(F.lit(name).alias("list_name"), i.alias("item_pos"), x.alias("item")))


def p3_struct_items(spark: SparkSession, d: str) -> DataFrame:
    """The same child table from the typed struct of embedding_documents."""
    docs = table(spark, d, "embedding_documents")
    items = [F.transform(F.col("metadata.arguments"), lambda x, i: F.struct(F.lit("arguments").alias("list_name"), i.alias("item_pos"), F.when(x.isNotNull(), F.coalesce(x["name"], F.lit(""))).alias("item")))]
    items += [_tagged(n) for n in N.ITEM_LISTS[1:]]
    empty = F.array().cast("array<struct<list_name:string,item_pos:int,item:string>>")
    return docs.select("row_id", F.inline(F.concat(*[F.coalesce(i, empty) for i in items]))).filter(F.col("item").isNotNull())


_CLEAN = r"regexp_replace(translate({}, '[]!', ''), '^\s+|\s+$', '', 'g')"
_REFS = f"""
raw as (
  select row_id, collection, loaded_at, 'fieldType' as ref_field, metadata.fieldType as v from embedding_documents
  union all select row_id, collection, loaded_at, 'parentType', metadata.parentType from embedding_documents
  union all select row_id, collection, loaded_at, 'possibleTypes', unnest(metadata.possibleTypes) from embedding_documents),
refs as (
  select distinct row_id, collection, loaded_at, ref_field, {_CLEAN.format('v')} as ref_name from raw
  where v is not null and {_CLEAN.format('v')} <> '' and {_CLEAN.format('v')} not in (select name from builtin_types)),
targets as (select collection, name, min(loaded_at) as lo, max(loaded_at) as hi from embedding_documents where type <> 'field' group by all),
gone as (select collection, type_name as name, max(removed_at) as gone from removals group by all),
state as (
  select r.*, case when t.name is null then 'missing' when g.gone > t.hi then 'deleted' when t.lo > r.loaded_at + interval 24 hours then 'late' end as status
  from refs r left join targets t on t.collection = r.collection and t.name = r.ref_name
  left join gone g on g.collection = r.collection and g.name = r.ref_name)
"""
_GRAPH = f"""
nodes as (select distinct collection, name as v from embedding_documents where type in ('object', 'interface', 'union') and name is not null),
raw as (
  select collection, {_CLEAN.format('metadata.parentType')} as a, {_CLEAN.format('metadata.fieldType')} as b from embedding_documents where type = 'field'
  union all select collection, name, {_CLEAN.format('x')} from (select collection, name, unnest(metadata.possibleTypes) as x from embedding_documents where type = 'union')),
e as (
  select distinct raw.collection, a, b from raw
  join nodes n on n.collection = raw.collection and n.v = a join nodes m on m.collection = raw.collection and m.v = b),
roots as (select * from nodes n where not exists (select 1 from e where e.collection = n.collection and e.b = n.v and e.a <> e.b)),
lv as (
  select collection, v, 0 as d from roots
  union select e.collection, e.b, d + 1 from lv join e on e.collection = lv.collection and e.a = lv.v where d < 100),
dep as (select collection, v, min(d) as d from lv group by all),
rt as (
  select collection, v, v as root, 0 as d from roots
  union select e.collection, e.b, root, dep.d from rt join e on e.collection = rt.collection and e.a = rt.v
    join dep on dep.collection = e.collection and dep.v = e.b and dep.d = rt.d + 1),
best as (select collection, v, min(root) as root from rt group by all),
reach as (
  select collection, a, b from e
  union select r.collection, r.a, e.b from reach r join e on e.collection = r.collection and e.a = r.b),
cyc as (select distinct collection, a as v from reach where a = b)
"""

def _list(x: str) -> str:
    """SQL of a JSON value as a list: nothing for null, itself for a list, else a list of one."""
    return f"case when {x} is null or json_type({x}) = 'NULL' then [] when json_type({x}) = 'ARRAY' then json_extract({x}, '$[*]') else [{x}] end"


_JSON = f"""
top as (select batch_id, payload::json as j from raw_batches where json_valid(payload) and json_type(payload::json) = 'OBJECT'),
subs as (select batch_id, unnest(l) as s, generate_subscripts(l, 1) - 1 as subgraph_pos from (select batch_id, {_list("(j->'$.design.subgraphs')")} as l from top)),
docs as (select batch_id, subgraph_pos, unnest(l) as d, generate_subscripts(l, 1) - 1 as doc_pos from (select batch_id, subgraph_pos, {_list("(s->'$.documents')")} as l from subs)),
meta as (select batch_id, subgraph_pos, doc_pos, d, case when json_type(m) = 'VARCHAR' then case when json_valid(m->>'$') then (m->>'$')::json end else m end as m from (select *, d->'$.metadata' as m from docs)),
items as ({" union all ".join(f"select batch_id, subgraph_pos, doc_pos, '{n}' as list_name, unnest(l) as x, generate_subscripts(l, 1) - 1 as item_pos from (select *, {_list(f'(m->' + repr(f'$.{n}') + ')')} as l from meta)" for n in N.ITEM_LISTS)})"""

_SCALAR = "('VARCHAR', 'BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE', 'BOOLEAN')"
_ARGS = f"""{_JSON},
args as (select batch_id, subgraph_pos, doc_pos, unnest(l) as x, generate_subscripts(l, 1) - 1 as arg_pos from (select *, {_list("(m->'$.arguments')")} as l from meta)),
dirs as (select batch_id, subgraph_pos, doc_pos, arg_pos, unnest(l) as y, generate_subscripts(l, 1) - 1 as directive_pos from (select *, json_extract(x, '$.directives[*]') as l from args where json_type(x) = 'OBJECT')),
vals as (select batch_id, subgraph_pos, doc_pos, arg_pos, directive_pos, unnest(l) as z, generate_subscripts(l, 1) - 1 as value_pos from (select *, json_extract(y, '$.args[*]') as l from dirs where json_type(y) = 'OBJECT'))"""
_POS = "subgraph_pos::integer as subgraph_pos, doc_pos::integer as doc_pos, arg_pos::integer as arg_pos"

_TREE = f"""{_GRAPH},
par as (
  select e.collection, e.b as v, min(e.a) as parent from e
  join dep x on x.collection = e.collection and x.v = e.a join dep y on y.collection = e.collection and y.v = e.b and y.d = x.d + 1
  join best p on p.collection = e.collection and p.v = e.a join best q on q.collection = e.collection and q.v = e.b and q.root = p.root group by all),
pth as (
  select collection, v, v as path, null::varchar as parent from roots
  union all select par.collection, par.v, path || '/' || par.v, par.parent from pth join par on par.collection = pth.collection and par.parent = pth.v),
anc as (
  select collection, parent as a, v, 1 as dist from par
  union all select anc.collection, par.parent, anc.v, dist + 1 from anc join par on par.collection = anc.collection and par.v = anc.a)"""

QUERIES = {f.__name__: f for f in (p3_found, p3_batches, p3_subgraphs, p3_documents, p3_arguments, p3_argument_properties, p3_directives, p3_directive_arguments, p3_groups, p3_struct_items, p5_found, p5_report, p6_found, p6_paths, p6_chains, p6_descendants, p6_all_descendants)}

SQL = {
    "p3_found": f"""with {_JSON}
select batch_id, subgraph_pos::integer as subgraph_pos, doc_pos::integer as doc_pos, list_name, item_pos::integer as item_pos,
  case when json_type(x) = 'OBJECT' then coalesce(x->>'$.name', '') else x->>'$' end as item
from items where json_type(x) <> 'NULL'""",
    "p3_batches": f"with {_JSON} select batch_id, j->>'$.collection' as collection, j->>'$.design.config_path' as config_path, j->>'$.design.federation_version' as federation_version from top",
    "p3_subgraphs": f"with {_JSON} select batch_id, subgraph_pos::integer as subgraph_pos, s->>'$.name' as name, s->>'$.routing_url' as routing_url from subs where json_type(s) = 'OBJECT'",
    "p3_documents": f"""with {_JSON} select batch_id, subgraph_pos::integer as subgraph_pos, doc_pos::integer as doc_pos, d->>'$.id' as id, d->>'$.type' as type, d->>'$.name' as name, d->>'$.description' as description,
  m->>'$.parentType' as parent_type, m->>'$.fieldType' as field_type, m->>'$.kind' as kind from meta where json_type(d) = 'OBJECT'""",
    "p3_arguments": f"""with {_ARGS} select batch_id, {_POS}, case when json_type(x) = 'OBJECT' then x->>'$.name' else x->>'$' end as name,
  case when json_type(x->'$.type') in {_SCALAR} then x->>'$.type' end as type, x->>'$.type.kind' as type_kind, x->>'$.type.name' as type_name, x->>'$.description' as description
from args where json_type(x) not in ('NULL', 'ARRAY')""",
    "p3_argument_properties": f"""with recursive {_ARGS},
props as (
  select batch_id, subgraph_pos, doc_pos, arg_pos, unnest(json_keys(x)) as property, x as holder from args where json_type(x) = 'OBJECT'),
walk as (
  select batch_id, subgraph_pos, doc_pos, arg_pos, property, json_extract(holder, '$.' || property) as v from props
  union all
  select batch_id, subgraph_pos, doc_pos, arg_pos, property || '.' || k, json_extract(v, '$.' || k) from (select *, unnest(json_keys(v)) as k from walk where json_type(v) = 'OBJECT'))
select batch_id, {_POS}, property, v->>'$' as value, case json_type(v) when 'VARCHAR' then 'string' when 'NULL' then 'null' when 'BOOLEAN' then 'bool' else 'number' end as kind
from walk where json_type(v) not in ('OBJECT', 'ARRAY')""",
    "p3_directives": f"with {_ARGS} select batch_id, {_POS}, directive_pos::integer as directive_pos, y->>'$.name' as name from dirs where json_type(y) = 'OBJECT'",
    "p3_directive_arguments": f"with {_ARGS} select batch_id, {_POS}, directive_pos::integer as directive_pos, value_pos::integer as value_pos, z->>'$.name' as name, z->>'$.value' as value from vals where json_type(z) = 'OBJECT'",
    "p3_struct_items": """
select row_id, list_name, cast(i - 1 as integer) as item_pos, item from (
  select row_id, 'arguments' as list_name, generate_subscripts(l, 1) as i, unnest(list_transform(l, lambda x: case when x is not null then coalesce(x.name, '') end)) as item from (select row_id, metadata.arguments as l from embedding_documents)
  union all select row_id, 'enumValues', generate_subscripts(l, 1), unnest(l) from (select row_id, metadata.enumValues as l from embedding_documents)
  union all select row_id, 'possibleTypes', generate_subscripts(l, 1), unnest(l) from (select row_id, metadata.possibleTypes as l from embedding_documents)
  union all select row_id, 'interfaces', generate_subscripts(l, 1), unnest(l) from (select row_id, metadata.interfaces as l from embedding_documents)
  union all select row_id, 'fields', generate_subscripts(l, 1), unnest(l) from (select row_id, metadata.fields as l from embedding_documents))
where item is not null""",
    "p5_found": f"with {_REFS} select row_id, ref_field, ref_name, status from state where status is not null",
    "p5_report": f"with {_REFS} select collection, strftime(loaded_at at time zone 'UTC', '%Y-%m') as month, ref_field, status, count(*) as n_refs, count(distinct ref_name) as n_names from state where status is not null group by all",
    "p6_found": f"""with recursive {_GRAPH}
select n.collection, n.v as type_name, coalesce(best.root, '') as root_name, cast(coalesce(dep.d, -1) as integer) as depth, cast(case when cyc.v is null then 0 else 1 end as integer) as on_cycle
from nodes n left join dep on dep.collection = n.collection and dep.v = n.v left join best on best.collection = n.collection and best.v = n.v left join cyc on cyc.collection = n.collection and cyc.v = n.v""",
    "p6_paths": f"""with recursive {_TREE}
select pth.collection, pth.v as type_name, best.root as root_name, cast(dep.d as integer) as depth, pth.parent as parent_name, pth.path,
  1 + (select count(*) from anc where anc.collection = pth.collection and anc.a = pth.v) as subtree_size
from pth join dep on dep.collection = pth.collection and dep.v = pth.v join best on best.collection = pth.collection and best.v = pth.v""",
    "p6_chains": f"""with recursive {_TREE},
size as (select dep.collection, dep.v, best.root, par.parent, 1 + (select count(*) from anc where anc.collection = dep.collection and anc.a = dep.v) as n
  from dep join best on best.collection = dep.collection and best.v = dep.v left join par on par.collection = dep.collection and par.v = dep.v),
ranked as (select *, row_number() over (partition by collection, parent order by n desc, v) as r from size),
placed as (select *, coalesce(sum(n) over (partition by collection, parent order by r > 1, case when r > 1 then substr(md5(v), 1, 2) end, v rows between unbounded preceding and 1 preceding), 0) as before from ranked),
walk as (
  select collection, v, root, n, v as chain, 0 as pos from placed where parent is null
  union all
  select p.collection, p.v, p.root, p.n, case when p.r = 1 then walk.chain else p.v end, cast(walk.pos + 1 + p.before as integer) from walk join placed p on p.collection = walk.collection and p.parent = walk.v)
select n.collection, n.v as type_name, coalesce(walk.root, '') as root_name, walk.chain, coalesce(walk.pos, -1)::integer as pos, coalesce(walk.n, 0)::integer as subtree_size
from nodes n left join walk on walk.collection = n.collection and walk.v = n.v""",
    "p6_descendants": f"with recursive {_TREE} select collection, a as type_name, v as descendant, cast(dist as integer) as distance from anc",
    "p6_all_descendants": f"""with recursive {_GRAPH},
most as (select collection, count(*) as n from nodes group by all),
walk as (
  select collection, a, b, 1 as d from e where a <> b
  union select walk.collection, walk.a, e.b, d + 1 from walk join e on e.collection = walk.collection and e.a = walk.b and e.b <> walk.b
    join most on most.collection = walk.collection where d < most.n and e.b <> walk.a)
select collection, a as type_name, b as descendant, cast(min(d) as integer) as distance from walk group by all""",
}
