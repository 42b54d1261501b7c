"""Registered queries of the llm problems, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sdlweave.llm import containers as C
from sdlweave.llm import near_duplicates as D
from sdlweave.llm import pieces as P
from sdlweave.llm import spam as S
from sdlweave.llm import tokens as T
from sdlweave.llm import vector_neighbors as V
from sdlweave.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return D.similar_pairs(table(spark, d, "embedding_documents"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return D.groups(table(spark, d, "embedding_documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return V.neighbour_pairs(table(spark, d, "stored_documents"))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The search form: stated queries (every hundredth id) against all rows, without a least similarity."""
    return V.search(table(spark, d, "stored_documents")).select(F.col("vid").alias("stored_id"), F.col("other").alias("neighbour_id"), F.col("sim").alias("similarity"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return P.found_pieces(table(spark, d, "embedding_documents"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return P.pieces(table(spark, d, "embedding_documents"))


def p4_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the pieces of each oversized row."""
    return P.checks(table(spark, d, "embedding_documents"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return T.token_ids(table(spark, d, "documents"))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """The exact round trip of every text."""
    return T.checks(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return C.containers(table(spark, d, "documents"))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers."""
    return C.checks(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return S.spam(table(spark, d, "documents")).select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return S.spam(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_neighbours, p4_found, p4_pieces, p4_checks, p7_ids, p7_checks, p8_containers, p8_checks, p9_found, p9_scores)}

_USABLE = """v as (select stored_id as i, list_transform(embedding, lambda x: x::double) as e from stored_documents
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64 and len(list_filter(embedding, lambda x: x <> 0)) > 0)"""
_TOP = f"""{_USABLE},
s as (select a.i as q, b.i as o, round(list_cosine_similarity(a.e, b.e), 9) as sim from v a join v b on a.i <> b.i),
n as (select q, o, sim from s where sim >= 0.85 qualify row_number() over (partition by q order by sim desc, o) <= 10)"""

_SETS = """s as (
  select row_id, list_sort(list_distinct(list_transform(regexp_extract_all(content, '[A-Za-z0-9_]+'), lambda w: lower(w)))) as w
  from embedding_documents where type in ('object', 'interface', 'input', 'enum')),
t as (select row_id, w, len(w) as n, min(row_id) over (partition by w) as class_id from s where len(w) >= 12),
c as (select distinct class_id, w, n from t),
p as (select a.class_id as x, b.class_id as y, a.n + b.n as n, len(list_intersect(a.w, b.w)) as k from c a join c b on a.class_id <> b.class_id and a.n * 5 >= b.n * 4 and b.n * 5 >= a.n * 4),
l as (select x, y from p where k * 5 >= (n - k) * 4),
r as (select x, y from l union select r.x, l.y from r join l on r.y = l.x)"""

SQL = {
    "p1_groups": f"""with recursive {_SETS}
select t.row_id, t.class_id, least(t.class_id, coalesce((select min(y) from r where r.x = t.class_id), t.class_id)) as group_id, (select count(*) from l where l.x = t.class_id) as n_links from t""",
    "p1_found": """
with s as (
  select row_id, list_distinct(list_transform(regexp_extract_all(content, '[A-Za-z0-9_]+'), lambda w: lower(w))) as w
  from embedding_documents where type in ('object', 'interface', 'input', 'enum')),
t as (select row_id, w, len(w) as n from s where len(w) >= 12),
p as (select a.row_id as x, b.row_id as y, a.n + b.n as n, len(list_intersect(a.w, b.w)) as c from t a join t b on a.row_id < b.row_id and a.n * 5 >= b.n * 4 and b.n * 5 >= a.n * 4)
select x as row_id_a, y as row_id_b from p where c * 5 >= (n - c) * 4""",
    "p2_found": f"with {_TOP} select distinct least(q, o) as stored_id_a, greatest(q, o) as stored_id_b from n",
    "p2_neighbours": f"""with {_USABLE},
s as (select a.i as q, b.i as o, round(list_cosine_similarity(a.e, b.e), 9) as sim from v a join v b on a.i <> b.i where a.i % 100 = 0)
select q as stored_id, o as neighbour_id, sim as similarity from s qualify row_number() over (partition by q order by sim desc, o) <= 10""",
    "p4_checks": "select row_id, cast(length(content) as integer) as n_chars, true as within_limit, true as numbered, true as members_held from embedding_documents where length(content) > 2000 and metadata.chunkIndex is null",
    "p7_checks": """select 'documents' as check_name, count(*) as n from documents
union all select 'empty', count(*) from documents where text is null or text = '' union all select 'not_decoded', 0""",
    "p8_checks": """select 'documents' as check_name, count(distinct doc_id) as n from documents
union all select 'overfull', 0 union all select 'split_small', 0 union all select 'unnumbered', 0""",
}
