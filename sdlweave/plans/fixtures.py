"""Queries over a schema text of our own, with answers derived by hand from the rules.

The text covers every kind of definition: roots, an extension, a cycle, descriptions with signs, defaults,
deprecation, an enum used as input without suffix and one with it used as output, and composed directives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sdlweave.operators import designs as D
from sdlweave.operators import federation, lint
from sdlweave.operators.validation import validate_operation, validate_schema
from sdlweave.sdl.documents import chunk_documents, parse_documents, syntax_errors
from sdlweave.sources.files import configs
from sdlweave.sources.introspection import to_sdl

SHOP = '''
# a comment, with "signs" { }
"""
The shop: (all) of {it}
"""
type Query {
  order(id: ID!, state: State = OPEN): Order
  listOrders: [Order!]!
}
type Mutation { place_order(input: PlaceOrder!): Order @deprecated(reason: "old") }
type Subscription { changed: StateInput }
interface Node { id: ID! }
"One order"
type Order implements Node { id: ID!, buyer: Buyer, state: State! }
type Buyer { id: ID!, orders(first: Int = 10): [Order] }
union Found = Order | Buyer
enum State { OPEN closed }
enum StateInput { A }
input PlaceOrder { Note: String, state: State }
scalar DateType
directive @Old_mark on FIELD_DEFINITION
extend type Buyer { name: String }
'''
BROKEN = "type A { b: }"

SUPER = '''
enum join__Graph { ORDERS @join__graph(name: "orders", url: "http://o") USERS @join__graph(name: "users", url: "http://u") LOST }
type Order @join__type(graph: ORDERS, key: "id") @join__type(graph: USERS, key: "id sku") @join__type(graph: LOST, key: "id") { id: ID! sku: String total: Int @inaccessible }
type Plain @join__type(graph: ORDERS) { a: Int }
type Query @join__type(graph: ORDERS) { order: Order _service: _Service! }
scalar join__FieldSet
type _Service { sdl: String }
directive @join__type(graph: join__Graph!, key: join__FieldSet) repeatable on OBJECT
'''
CONNECT = '''
type Query {
  user(id: ID!, region: String): User @connect(source: "v1", entity: true)
  users: [User] @connect(entity: true)
  off(id: ID!): User @connect(entity: false)
}
type User { id: String! name: String }
'''
REFERENCES = '''
type Order @key(fields: "id") @key(fields: "id sku") { id: ID! }
extend type User @key(fields: "name") {
'''
CONFIG = '''federation_version: =2.9.1
subgraphs:
  orders:
    routing_url: http://o
    schema:
      file: ./orders.graphql
  remote:
    schema:
      subgraph_url: http://r
'''
INTROSPECTION = {
    "data": {
        "__schema": {
            "queryType": {"name": "Root"},
            "types": [
                {"kind": "OBJECT", "name": "Root", "description": "Start", "interfaces": [], "fields": [{"name": "a", "args": [{"name": "n", "type": {"kind": "NON_NULL", "ofType": {"kind": "SCALAR", "name": "Int"}}, "defaultValue": "1"}], "type": {"kind": "LIST", "ofType": {"kind": "ENUM", "name": "E"}}, "isDeprecated": True, "deprecationReason": "gone"}]},
                {"kind": "ENUM", "name": "E", "enumValues": [{"name": "X"}, {"name": "Y", "isDeprecated": True}]},
                {"kind": "SCALAR", "name": "Int"},
                {"kind": "OBJECT", "name": "__Type", "fields": [], "interfaces": []},
            ],
            "directives": [{"name": "skip", "locations": ["FIELD"], "args": []}],
        }
    }
}
OUTPUT = """{"error": {"details": {"build_errors": [
 {"message": "Type of field \\"Order.id\\" differs in \\"orders\\" and \\"users\\"", "nodes": [{"subgraph": "ORDERS", "start": {"line": 3, "column": 5}, "end": {"line": 3, "column": 9}}]},
 {"message": "bad link", "nodes": [{"subgraph": "Users", "start": {"line": 1, "column": 2}, "end": {"line": 1, "column": 4}}]},
 {"message": "[users] fails", "nodes": []},
 {"message": "unknown trouble", "nodes": null},
 {"message": "see ╭─[ users:3:7 ] there", "nodes": []}]}}}"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def fixture(columns: str, values: str):
    """Register a query with its rows as a SQL table of values."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(spark)
        SQL[f.__name__] = f"select * from (values {values.strip()}) t({columns})"
        return f

    return add


def _texts(spark: SparkSession, **texts: str) -> DataFrame:
    return spark.createDataFrame(list(texts.items()), "path string, sdl string")


#: SQL of the content id, for texts within the basic plane.
_ID = "lower(to_base(abs(list_reduce(list_prepend(0::bigint, list_transform(string_split(content, ''), lambda c: ord(c)::bigint)), lambda h, c: ((31 * h + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)), 36))"


@fixture(
    "ordinal, type, name, content, parent, field_type, root",
    """
(0, 'field', 'order', 'Query.order(id:ID!state:State=OPEN):Order', 'Query', 'Order', 'Query'),
(1, 'field', 'listOrders', 'Query.listOrders:[Order!]!', 'Query', '[Order!]!', 'Query'),
(2, 'field', 'place_order', 'Mutation.place_order(input:PlaceOrder!):Order@deprecated(reason:"old")', 'Mutation', 'Order', 'Mutation'),
(3, 'field', 'changed', 'Subscription.changed:StateInput', 'Subscription', 'StateInput', 'Subscription')""",
)
def sdl_root_fields(spark):
    docs = parse_documents(_texts(spark, shop=SHOP, broken=BROKEN))
    m = F.col("metadata")
    return docs.filter("metadata.isRootOperationField").select("id", "ordinal", "type", "name", "content", m["parentType"].alias("parent"), m["fieldType"].alias("field_type"), m["rootOperationType"].alias("root"))


SQL["sdl_root_fields"] = SQL["sdl_root_fields"].replace("select *", f"select {_ID} as id, *", 1)


@fixture(
    "type, name, content, n_fields",
    """
('interface', 'Node', 'interface Node{id:ID!}', 1), ('object', 'Order', '"One order" type Order implements Node{id:ID!buyer:Buyer state:State!}', 3),
('object', 'Buyer', 'type Buyer{id:ID!orders(first:Int=10):[Order]}', 2), ('union', 'Found', 'union Found=Order|Buyer', -1),
('enum', 'State', 'enum State{OPEN closed}', -1), ('enum', 'StateInput', 'enum StateInput{A}', -1),
('input', 'PlaceOrder', 'input PlaceOrder{Note:String state:State}', 2), ('scalar', 'DateType', 'scalar DateType', -1)""",
)
def sdl_types(spark):
    docs = parse_documents(_texts(spark, shop=SHOP)).filter("type <> 'field'")
    return docs.select("type", "name", "content", F.coalesce(F.size("metadata.fields"), F.lit(-1)).alias("n_fields"))


@fixture("content, chunk_index, total_chunks", """('"One order" type Order implements Node{id:ID!}', 0, 3), ('"One order" type Order implements Node{buyer:Buyer }', 1, 3), ('"One order" type Order implements Node{state:State!}', 2, 3)""")
def sdl_chunks(spark):
    docs = parse_documents(_texts(spark, shop=SHOP)).filter("name = 'Order' and type = 'object'")
    return chunk_documents(docs, 50).select("content", F.col("metadata.chunkIndex").alias("chunk_index"), F.col("metadata.totalChunks").alias("total_chunks"))


@fixture("path, message, line, \"column\"", "('broken', 'Syntax Error: Expected Name, found }.', 1, 13)")
def sdl_syntax_errors(spark):
    return syntax_errors(_texts(spark, shop=SHOP, broken=BROKEN))


@fixture(
    "rule, line, \"column\", length",
    """
('RESTY_FIELD_NAMES', 7, 2, 10), ('FIELD_NAMES_SHOULD_BE_CAMEL_CASE', 9, 16, 11), ('INPUT_TYPE_SUFFIX', 18, 6, 10),
('INPUT_ARGUMENT_NAMES_SHOULD_BE_CAMEL_CASE', 18, 19, 4), ('ENUM_VALUES_SHOULD_BE_SCREAMING_SNAKE_CASE', 16, 18, 6),
('TYPE_SUFFIX', 19, 7, 8), ('DIRECTIVE_NAMES_SHOULD_BE_CAMEL_CASE', 20, 11, 8),
('ENUM_USED_AS_INPUT_WITHOUT_SUFFIX', 16, 5, 5), ('ENUM_USED_AS_OUTPUT_DESPITE_SUFFIX', 17, 5, 10)""",
)
def sdl_lint(spark):
    return lint.lint(lint.nodes(_texts(spark, shop=SHOP))).select("rule", "line", "column", "length")


@fixture(
    "position, grp, n, first",
    """(1, 'Queries', 2, 'order'), (2, 'Mutations', 1, 'place_order'), (3, 'Subscriptions', 1, 'changed'), (4, 'Types', 3, 'Order'), (5, 'Interfaces', 1, 'Node'),
(6, 'Enums', 2, 'State'), (7, 'Unions', 1, 'Found'), (8, 'Inputs', 1, 'PlaceOrder'), (9, 'Scalars', 1, 'DateType')""",
)
def sdl_outline(spark):
    return lint.outline(lint.nodes(_texts(spark, shop=SHOP))).select("position", "grp", F.col("n").cast("int").alias("n"), F.col("names")[0].alias("first"))


@fixture("type_name, key_fields, subgraph_name, n_fields", "('Order', 'id', 'orders', 3), ('Order', 'id sku', 'users', 3)")
def sdl_entities(spark):
    return federation.supergraph_entities(_texts(spark, s=SUPER)).select("type_name", "key_fields", "subgraph_name", F.size("fields").alias("n_fields"))


@fixture("type_name, key_fields, names, types", "('User', 'id region', 'id,region', 'String!,String')")
def sdl_connect_entities(spark):
    e = federation.connect_entities(_texts(spark, c=CONNECT))
    return e.select("type_name", "key_fields", F.array_join(F.transform("fields", lambda f: f["name"]), ",").alias("names"), F.array_join(F.transform("fields", lambda f: f["type"]), ",").alias("types"))


@fixture("type_name, key_fields, stub", "('User', 'id region', 'type User @key(fields: \"id region\") {' || chr(10) || '  id: String!' || chr(10) || '  region: String' || chr(10) || '}')")
def sdl_entity_stubs(spark):
    both = federation.supergraph_entities(_texts(spark, s=SUPER)).unionByName(federation.connect_entities(_texts(spark, c=CONNECT)).withColumn("subgraph_name", F.lit("connect")))
    return federation.entity_stubs(both, "reviews", federation.referenced_keys(_texts(spark, doc=REFERENCES))).select("type_name", "key_fields", "stub")


@fixture("sdl", "('type Order{id:ID!sku:String total:Int}type Plain{a:Int}type Query{order:Order}')")
def sdl_api_schema(spark):
    return spark.createDataFrame([(federation.api_schema(SUPER),)], "sdl string")


@fixture("name, schema_path, version, line", "('orders', 'designs/shop/orders.graphql', '=2.9.1', 1)")
def config_subgraphs(spark):
    c = configs(spark.createDataFrame([("designs/shop/supergraph.yaml", CONFIG), ("designs/bad/supergraph.yaml", "a: [")], "path string, value string"))
    return c.select(F.explode("subgraphs").alias("s"), F.col("federation_version").alias("version"), F.col("federation_version_line").alias("line")).select("s.name", "s.schema_path", "version", "line")


@fixture("n, sdl", """(1, 'schema {' || chr(10) || '  query: Root' || chr(10) || '}'), (2, '\"\"\"Start\"\"\"' || chr(10) || 'type Root {' || chr(10) || '  a(n: Int! = 1): [E] @deprecated(reason: "gone")' || chr(10) || '}'), (3, 'enum E {' || chr(10) || '  X' || chr(10) || '  Y @deprecated' || chr(10) || '}')""")
def introspection_sdl(spark):
    parts = to_sdl(INTROSPECTION).strip().split("\n\n")
    return spark.createDataFrame(list(enumerate(parts, 1)), "n int, sdl string")


@fixture(
    "error_no, subgraph_name, file, message, line, \"column\"",
    """
(0, 'orders', 'o.graphql', '[orders] Type of field "Order.id" differs in "orders" and "users"', 2, 5), (0, 'users', 'u.graphql', '[users] Type of field "Order.id" differs in "orders" and "users"', -1, -1),
(1, 'users', 'u.graphql', 'bad link', 0, 2), (2, 'users', 'u.graphql', '[users] fails', -1, -1), (3, 'orders', 'o.graphql', 'unknown trouble', -1, -1), (4, 'users', 'u.graphql', 'see ╭─[ users:3:7 ] there', -1, -1)""",
)
def compose_errors(spark):
    errors = D.build_errors(spark.createDataFrame([(1, OUTPUT), (2, "not json")], "run_id int, output string"))
    subs = spark.createDataFrame([(0, "orders", "o.graphql"), (1, "users", "u.graphql")], "subgraph_pos int, subgraph_name string, schema_path string")
    return D.place_errors(errors, subs).select("error_no", "subgraph_name", "file", "message", F.coalesce("line", F.lit(-1)).alias("line"), F.coalesce("column", F.lit(-1)).alias("column"))


@fixture("file, n, first", "('o.graphql', 2, '[orders] Type of field \"Order.id\" differs in \"orders\" and \"users\"'), ('u.graphql', 4, '[users] Type of field \"Order.id\" differs in \"orders\" and \"users\"')")
def diagnostics_by_file(spark):
    placed = QUERIES["compose_errors"](spark, "").withColumn("severity", F.lit("error"))
    g = D.group_diagnostics(placed.withColumn("message", F.when(F.col("error_no") == 0, F.col("message")).otherwise("x")))
    return g.select("file", F.col("n").cast("int").alias("n"), F.array_min(F.transform("diagnostics", lambda x: x["message"])).alias("first"))


@fixture("target, line, \"column\", end_column", "('Order', 13, 5, 10), ('Order.buyer', 13, 5, 10), ('Query.listOrders', 7, 2, 23), ('Order.none', 13, 5, 10)")
def locate_fields(spark):
    t = spark.createDataFrame([("Order",), ("Order.buyer",), ("Query.listOrders",), ("Order.none",), ("Missing",)], "target string").withColumn("sdl", F.lit(SHOP))
    return t.select("target", D.locate_column(F.col("sdl"), F.col("target")).alias("p")).filter("p is not null").select("target", "p.line", "p.column", "p.end_column")


@fixture(
    "operation, message",
    """('{ order(id: 1) { id } }', null), ('{ order { id } }', 'Field "order" argument "id" of type "ID!" is required, but it was not provided.'),
('{ order(id: 1) { nope } }', 'Cannot query field "nope" on type "Order".'), ('{ order(id: 1) }', 'Field "order" of type "Order" must have a selection of subfields.'),
('{ order(id: 1, x: 2) { id { a } } }', 'Unknown argument "x" on field "Query.order".'), ('query($a: ID!) { order(id: $b) { id } }', 'Variable "$b" is not defined.'), ('{', 'Syntax Error: Expected Name, found <EOF>.')""",
)
def operation_checks(spark):
    ops = ["{ order(id: 1) { id } }", "{ order { id } }", "{ order(id: 1) { nope } }", "{ order(id: 1) }", "{ order(id: 1, x: 2) { id { a } } }", "query($a: ID!) { order(id: $b) { id } }", "{"]
    return spark.createDataFrame([(o, next(iter(validate_operation(o, SHOP)), None)) for o in ops], "operation string, message string")


@fixture("name, message", """('empty', 'Schema is empty'), ('broken', 'Syntax Error: Expected Name, found }.'), ('unknown', 'Unknown type "B".'), ('twice', 'There can be only one type named "A".'), ('rootless', 'Query root type must be provided.'), ('interface', 'Interface field N.id expected but A does not provide it.')""")
def schema_checks(spark):
    texts = {"empty": " ", "broken": BROKEN, "unknown": "type Query { a: B }", "twice": "type Query { a: A } type A { b: Int } type A { c: Int }", "rootless": "type A { b: Int }", "interface": "type Query { a: A } interface N { id: ID } type A implements N { b: Int }", "good": SHOP}
    return spark.createDataFrame([(n, e["message"]) for n, s in texts.items() for e in validate_schema(s)[:1]], "name string, message string")
