"""Orphan references, hierarchies and nested records against brute force, with the awkward cases."""

import json
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from helpers import same
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from sdlweave.functions import bitmaps as B
from sdlweave.operators import hierarchy as H
from sdlweave.operators import references as R
from sdlweave.operators.components import components
from sdlweave.runtime import salted_join
from sdlweave.sources import nested as N

DOC = "row_id long, type string, name string, collection string, loaded_at timestamp, metadata struct<parentType:string,fieldType:string,possibleTypes:array<string>>, key_id int, n int"
T0 = datetime(2024, 3, 1)


def docs(spark, rows):
    """``row_id, type, name, collection, hours, parent, field, members``; two more columns have clashing names."""
    return spark.createDataFrame([(i, t, n, c, None if h is None else T0 + timedelta(hours=h), (p, f, m) if (p, f, m) != (None,) * 3 else None, i, i) for i, t, n, c, h, p, f, m in rows], DOC)


def clean(x):
    return x.replace("[", "").replace("]", "").replace("!", "").strip()


def brute_orphans(rows, removals, builtin):
    out = set()
    for i, _, _, c, h, p, f, m in rows:
        for field, vs in (("fieldType", [f]), ("parentType", [p]), ("possibleTypes", m or [])):
            for v in vs:
                name = clean(v) if v is not None else ""
                if not name or name in builtin:
                    continue
                loads = [x[4] for x in rows if x[3] == c and x[2] == name and x[1] is not None and x[1] != "field"]
                known = [x for x in loads if x is not None]
                gone = [x[2] for x in removals if x[0] == c and x[1] == name]
                if not loads:
                    out.add((i, field, name, "missing"))
                elif gone and known and max(gone) > max(known):
                    out.add((i, field, name, "deleted"))
                elif known and h is not None and min(known) > h + 24:
                    out.add((i, field, name, "late"))
    return out


def test_orphans_brute_force(spark):
    rnd = random.Random(4)
    names = ["A", "B", "C", "D", None]
    dirty = lambda n: None if n is None else rnd.choice([n, f" {n}", f"[{n}!]!", f"\t{n} ", f"[ {n}]"])
    rows = [(i, rnd.choice(["object", "field", "union", None]), rnd.choice(names), rnd.choice(["x", "y", None]), rnd.choice([0, 10, 30, 100, 2000, None]), dirty(rnd.choice([*names, "Int", ""])), dirty(rnd.choice([*names, "", "Gone"])), rnd.choice([None, [], [dirty("A"), None, "A", "Z"]])) for i in range(300)]
    rows.append((900, "field", "f", "x", 5, None, "Q" * 50_000, None))
    removals = [(rnd.choice(["x", "y", None]), rnd.choice(["A", "B", "C", "D"]), rnd.choice([5, 50, 3000])) for _ in range(6)]
    gone = spark.createDataFrame([(c, n, T0 + timedelta(hours=h)) for c, n, h in removals], "collection string, type_name string, removed_at timestamp")
    builtin = spark.createDataFrame([("Int", "scalar")], "name string, category string")
    d = docs(spark, rows)
    got = R.orphan_references(d, gone, builtin)
    want = brute_orphans(rows, removals, {"Int"})
    found = [tuple(r) for r in got.select("row_id", "ref_field", "ref_name", "status").collect()]
    assert len(found) == len(set(found)) and set(found) == want
    report = R.orphan_report(d, gone, builtin).collect()
    month = lambda h: None if h is None else (T0 + timedelta(hours=h)).strftime("%Y-%m")
    of = {r[0]: r for r in rows}
    groups = {}
    for i, field, name, status in want:
        groups.setdefault((of[i][3], month(of[i][4]), field, status), []).append(name)
    assert {tuple(r) for r in report} == {(*k, len(v), len(set(v))) for k, v in groups.items()} and len(report) == len(groups)
    assert R.orphan_references(d.limit(0), gone, builtin).count() == 0
    assert R.orphan_references(d, gone.limit(0), builtin.limit(0)).count() > 0


@settings(max_examples=100, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 65_535), max_size=200), st.tuples(st.integers(0, 60_000), st.integers(1, 5000), st.integers(1, 3)).map(lambda x: range(x[0], x[0] + x[1], x[2])), st.just(range(0, 65_536, 2))), st.lists(st.integers(0, 65_535), max_size=200))
def test_bitmaps(a, b):
    a, b = sorted({x for x in a if x < B.RANGE}), sorted(set(b))
    data, other = B.encode(a), B.encode(b)
    assert B.decode(data).tolist() == a and len(data) <= 8193
    assert B.decode(B.and_not(data, other)).tolist() == sorted(set(a) - set(b)) == B.decode(B.and_not(data, B.encode(b))).tolist()
    assert B.decode(B.both(data, other)).tolist() == sorted(set(a) & set(b)) and B.decode(None).tolist() == []


def brute_hierarchy(nodes, links):
    n = sorted(nodes)
    out = {v: sorted({b for a, b in links if a == v and b in nodes}) for v in n}
    reach = {}
    for v in n:
        seen, work = set(), list(out[v])
        while work:
            w = work.pop()
            if w not in seen:
                seen.add(w)
                work += out[w]
        reach[v] = seen
    roots = [v for v in n if not any(v in out[u] for u in n if u != v)]
    best = {v: ("", -1) for v in n}
    for r in roots:
        dist, front, d = {r: 0}, [r], 0
        while front:
            d += 1
            front = [w for w in sorted({x for u in front for x in out[u]}) if w not in dist]
            dist.update(dict.fromkeys(front, d))
        for v, d in dist.items():
            if best[v][1] < 0 or (d, r) < (best[v][1], best[v][0]):
                best[v] = (r, d)
    return {(v, *best[v], int(v in reach[v])) for v in n}


graphs = st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=25)


@settings(max_examples=200, deadline=None)
@given(graphs)
def test_hierarchy_solver(links):
    names = [f"T{i}" for i in range(10)]
    solved = H.Solved(names, sorted(set(links))).label()
    rows = list(zip(*solved.columns(range(10)), solved.paths()))
    assert {(r[0], r[1], r[2], r[3]) for r in rows} == brute_hierarchy(set(names), {(names[a], names[b]) for a, b in links})
    at = {r[0]: r for r in rows}
    for name, root, depth, _, parent, chain, pos, size, path in rows:
        if depth < 0:
            assert (root, parent, path, chain, pos, size) == ("", None, None, None, -1, 0)
            continue
        steps = path.split("/")
        assert steps[0] == root and steps[-1] == name and len(steps) == depth + 1
        assert (steps[-2] if depth else None) == parent
        inside = {r[0] for r in rows if r[1] == root and pos <= r[6] < pos + size}
        assert inside == {r[0] for r in rows if r[8] is not None and r[8].split("/")[: depth + 1] == steps}
        if depth and at[parent][5] != chain:  # a light child's subtree is at most half
            assert 2 * size <= at[parent][7]


def test_found_types_come_through_their_chains(spark, data, monkeypatch):
    from sdlweave.plans import problems

    trees, whole = [], H.hierarchy
    monkeypatch.setattr(H, "hierarchy", lambda *a, **k: trees.append(whole(*a, **k)) or trees[-1])
    assert problems.p6_found(spark, data).count() == trees[0].count() > 0
    led = trees[0].filter("depth >= 0")
    assert led.count() > led.filter("depth > 0").count() > 0 == led.filter("chain is null or pos < 0 or subtree_size < 1").count()
    solved = H.Solved(list("abcdef"), [(0, 1), (1, 2), (1, 3), (3, 4), (5, 5)])
    want = list(solved.root), list(solved.depth)
    for v in (1, 3, 4):  # below a head on the heavy chain
        solved.root[v] = solved.depth[v] = 7
    solved.label()
    assert (solved.root, solved.depth) == want


def hierarchy_rows(rnd, n=60):
    rows = []
    for i in range(n):
        c = rnd.choice(["x", "y", None])
        name = rnd.choice([f"N{k}" for k in range(14)] + [None, "Ä"])
        kind = rnd.choice(["object", "interface", "union", "field", "field", "enum", None])
        rows.append((i, kind, name, c, 0, rnd.choice([None, f" N{rnd.randrange(14)}"]), rnd.choice([None, f"[N{rnd.randrange(14)}!]"]), rnd.choice([None, [f"N{rnd.randrange(14)}", None]])))
    return rows


def test_hierarchy_both_ways(spark):
    rnd = random.Random(8)
    rows = hierarchy_rows(rnd)
    d = docs(spark, rows)
    local, spread = H.paths(d), H.paths(d, bound=5)
    same(local.toPandas(), spread.toPandas())
    same(H.hierarchy(d).toPandas(), local.drop("path").toPandas())
    want = set()
    for c in ("x", "y", None):
        nodes = {r[2] for r in rows if r[3] == c and r[1] in ("object", "interface", "union") and r[2] is not None}
        links = {(clean(r[5]), clean(r[6])) for r in rows if r[3] == c and r[1] == "field" and r[5] and r[6]}
        links |= {(r[2], clean(m)) for r in rows if r[3] == c and r[1] == "union" and r[2] for m in r[7] or [] if m}
        want |= {(c, *x) for x in brute_hierarchy(nodes, {(a, b) for a, b in links if a in nodes and b in nodes})}
    assert {tuple(r) for r in local.select("collection", "type_name", "root_name", "depth", "on_cycle").collect()} == want
    closure = H.descendants(local)
    assert closure.count() == local.filter("depth > 0").agg({"depth": "sum"}).first()[0]
    assert H.hierarchy(d.limit(0)).count() == 0 and H.hierarchy(d.limit(0), bound=-1).count() == 0


def test_a_very_long_chain_is_solved_in_linear_memory():
    n = 200_000
    solved = H.Solved([f"{i:06}" for i in range(n)], [(i, i + 1) for i in range(n - 1)]).label()
    assert solved.depth[-1] == n - 1 == solved.pos[-1] and solved.head[-1] == 0 and solved.size[0] == n


def test_deep_graphs_take_few_rounds(spark, monkeypatch):
    """Chains, a comb, a long ring and what hangs on it, by joins: rounds follow the logarithm of the depth."""
    n = 400
    pairs = [(f"c{i:05}", f"c{i + 1:05}") for i in range(n)] + [(f"c{i:05}", f"t{i:05}") for i in range(0, n, 3)]
    pairs += [(f"r{i:05}", f"r{(i + 1) % n:05}") for i in range(n)] + [("r00005", f"h{0:05}")] + [(f"h{i:05}", f"h{i + 1:05}") for i in range(n)] + [("c00000", "c00200"), ("c00005", "c00005"), *((f"q{i:02}", f"q{(i + 1) % 12:02}") for i in range(12)), ("c00009", "q03")]
    links = spark.createDataFrame([("x", a, b) for a, b in pairs] + [("x", v, None) for v in {v for p in pairs for v in p}], "_c string, src string, dst string")
    staged = []
    monkeypatch.setattr(H, "stage", lambda df, f=H.stage: staged.append(1) or f(df))
    got = {r["type_name"]: r for r in H.solve_distributed(links).collect()}
    assert len(staged) < 160
    names = sorted({v for p in pairs for v in p})
    at = {v: i for i, v in enumerate(names)}
    want = H.Solved(names, sorted((at[a], at[b]) for a, b in pairs)).label()
    for row in zip(*want.columns(range(len(names)))):
        r = got[row[0]]
        assert (r["root_name"], r["depth"], r["on_cycle"], r["parent_name"], r["chain"], r["pos"], r["subtree_size"]) == row[1:]


json_values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=12)


def rebuilt(text):
    """The value that the events of a text describe."""
    stack, keys = [[]], [None]

    def put(v):
        if isinstance(stack[-1], dict):
            stack[-1][keys[-1]] = v
        else:
            stack[-1].append(v)

    for kind, v in N.events(text):
        if kind == "key":
            keys[-1] = v
        elif kind in "{[":
            new = {} if kind == "{" else []
            put(new)
            stack.append(new)
            keys.append(None)
        elif kind in "}]":
            stack.pop()
            keys.pop()
        else:
            put(v if kind in ("string", "null") else json.loads(v))
    return stack[0][0]


@settings(max_examples=300, deadline=None)
@given(json_values, st.integers(0, 30), st.sampled_from(["", ",", "]", "}", "1", " ", ":", '"', "\\", "\x01"]))
def test_events_read_as_json_does(value, at, mark):
    text = json.dumps(value, indent=1)
    text = text[:at] + mark + text[at:]
    try:
        want = json.loads(text)
    except ValueError:
        with pytest.raises(ValueError):
            rebuilt(text)
    else:
        assert rebuilt(text) == want


def leaves(value, path=(), at=()):
    """Brute force: ancestor and step as tuples, ordinals and value of every scalar."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in leaves(v, (*path, k), at)]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in leaves(v, (*path, None), (*at, i))]
    return [(path, at, value if isinstance(value, str) or value is None else json.dumps(value))]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(max_size=3), json_values, max_size=4))
def test_triples_hold_every_scalar(value):
    paths, got = N.Paths(), []
    for ancestor, step, at, v, kind in N.triples_of(json.dumps(value), paths):
        if kind not in ("object", "list"):
            got.append((ancestor, step, tuple(at), v))
    want = []
    for path, at, v in leaves(value):
        last = max((i for i, s in enumerate(path) if s is None), default=-1) + 1
        want.append((N._written(list(path[:last])), N._written(list(path[last:])), at, v))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_any_depth_and_any_number_is_read(spark):
    n = 50_000
    head = '{"collection": "c", "design": {"subgraphs": [{"documents": [{"metadata": {"fields": ["a"]}}]}]}, "x": '
    deep = [head + "[" * n + "]" * n + "}", head + '{"k":' * n + "1" + "}" * n + "}", head + "9" * 10_000 + "}", head + "[{" * 3 + "}"]
    text = json.dumps('{"fields": ["a"], "x": ' + '{"k":[' * n + "]}" * n + "}")
    deep.append('{"collection": "c", "design": {"subgraphs": [{"documents": [{"metadata": ' + text + "}]}]}}")
    raw = spark.createDataFrame(list(enumerate(deep)), "batch_id long, payload string")
    assert sorted(tuple(r) for r in N.list_items(raw).collect()) == [(i, 0, 0, "fields", 0, "a") for i in (0, 1, 2, 4)]
    assert N.batches_table(raw).filter("collection = 'c'").count() == 4
    assert N.triples(raw, ["x"]).filter("step = 'x' and kind = 'number'").first()["value"] == "9" * 10_000


def test_repeated_keys_and_rows(spark):
    raw = spark.createDataFrame([(1, '{"collection": "a", "collection": "b", "design": {"subgraphs": 1}, "design": {"subgraphs": {"name": "s"}}}')] * 2 + [(2, '{"collection": "x"}'), (2, '{"collection": "y"}'), (None, '{"collection": "z"}')], "batch_id long, payload string")
    assert sorted((r["batch_id"] or 0, r["collection"]) for r in N.batches_table(raw).collect()) == [(0, "z"), (1, "b"), (2, "x"), (2, "y")]
    assert [tuple(r) for r in N.subgraphs_table(raw).collect()] == [(1, 0, "s", None)]


def test_tables_of_all_groups(spark, data):
    raw = spark.read.parquet(f"{data}/raw_batches.parquet")
    got = N.tables(raw)
    arg = got["design.subgraphs[].documents[].metadata.arguments[]"]
    assert {"name", "type", "description", "type.kind", "batch_id", "pos_3"} <= set(arg.columns)
    assert arg.filter("_kind = 'object'").count() == N.arguments_table(raw).join(arg.select("batch_id", F.col("pos_1").alias("subgraph_pos"), F.col("pos_2").alias("doc_pos"), F.col("pos_3").alias("arg_pos"), "_kind").filter("_kind = 'object'"), ["batch_id", "subgraph_pos", "doc_pos", "arg_pos"], "left_semi").count()
    assert got["*"].count() == 0
    few = N.tables(raw, columns=3, most=2)
    assert len(few) == 3 and few["*"].count() > 0
    directives, values = N.directives_table(raw), N.directive_arguments(raw)
    keys = ["batch_id", "subgraph_pos", "doc_pos", "arg_pos"]
    assert directives.join(N.arguments_table(raw), keys, "left_anti").count() == 0 == values.join(directives, [*keys, "directive_pos"], "left_anti").count()


def test_all_descendants(spark):
    """A second parent (D), a rootless cycle (X, Y) and what hangs on it (Z): the forest has none of these pairs."""
    names = "ABCDXYZ"
    rows = [(i, "object", v, "x", 0, None, None, None) for i, v in enumerate(names)]
    rows += [(50 + i, "field", "f", "x", 0, a, b, None) for i, (a, b) in enumerate(["AB", "AC", "BD", "CD", "XY", "YX", "YZ", "ZZ"])]
    want = {("A", "B", 1), ("A", "C", 1), ("A", "D", 2), ("B", "D", 1), ("C", "D", 1), ("X", "Y", 1), ("X", "Z", 2), ("Y", "X", 1), ("Y", "Z", 1)}
    d = docs(spark, rows)
    for bound in (H.BOUND, 1):
        assert sorted(tuple(r) for r in H.all_descendants(d, bound).collect()) == sorted(("x", *w) for w in want)
    d = docs(spark, hierarchy_rows(random.Random(9), 600))
    one, spread = H.all_descendants(d), H.all_descendants(d, bound=40)
    assert one.count() > 50
    same(one.toPandas(), spread.toPandas())
    assert H.all_descendants(d.limit(0)).count() == 0


def brute_items(payload):
    def as_list(x):
        return [] if x is None else x if isinstance(x, list) else [x]

    try:
        top = json.loads(payload)
    except (TypeError, ValueError):
        return []
    out = []
    design = top.get("design") if isinstance(top, dict) else None
    for i, s in enumerate(as_list(design.get("subgraphs")) if isinstance(design, dict) else []):
        for j, doc in enumerate(as_list(s.get("documents")) if isinstance(s, dict) else []):
            m = doc.get("metadata") if isinstance(doc, dict) else None
            if isinstance(m, str):
                try:
                    m = json.loads(m)
                except ValueError:
                    m = None
            for n in N.ITEM_LISTS:
                for k, x in enumerate(as_list(m.get(n)) if isinstance(m, dict) else []):
                    if x is not None:
                        out.append((i, j, n, k, (x.get("name") or "") if isinstance(x, dict) else x))
    return out


def test_nested_items_brute_force(spark, data):
    payloads = [r["payload"] for r in spark.read.parquet(f"{data}/raw_batches.parquet").collect()]
    payloads += [None, "", "[]", "null", "{", '"x"', '{"design": 3}', '{"design": {"subgraphs": {"documents": {"metadata": {"fields": "a", "arguments": [null, {"name": null}, {}, "s"]}}}}}']
    payloads += ['{"design": {"subgraphs": [null, {"documents": [null, 5, {"metadata": "{\\"fields\\": [\\"x\\", null, \\"y\\"]}"}]}], "sub.graphs": [1]}}', '{"design": {"subgraphs": [{"documents": [{"metadata": "not json"}]}]}}', '{"a": NaN}', '{"a":' * 5000]
    payloads.append(json.dumps({"design": {"subgraphs": [{"documents": [{"metadata": {"fields": [f"f{i}" * 200 for i in range(3000)]}}]}]}}))
    raw = spark.createDataFrame([(i, p, i) for i, p in enumerate([*payloads, payloads[0]])], "batch_id long, payload string, path int")
    got = N.list_items(raw).toPandas()
    want = pd.DataFrame([(i, *x) for i, p in enumerate([*payloads, payloads[0]]) for x in brute_items(p)], columns=got.columns)
    same(got, want)
    assert N.batches_table(raw).count() <= len(payloads)
    parents = N.documents_table(raw).select("batch_id", "subgraph_pos", "doc_pos").distinct()
    items = N.list_items(raw).select("batch_id", "subgraph_pos", "doc_pos").distinct()
    assert items.join(parents, ["batch_id", "subgraph_pos", "doc_pos"], "left_anti").count() == 0
    subs = N.subgraphs_table(raw).select("batch_id", "subgraph_pos")
    assert parents.join(subs, ["batch_id", "subgraph_pos"], "left_anti").count() == 0
    assert N.list_items(raw.limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_salted_join_equals_join(spark):
    big = spark.createDataFrame([(i % 3 if i % 2 else 7, i) for i in range(500)], "k int, v int")
    small = spark.createDataFrame([(7, "a"), (7, "b"), (1, "c"), (None, "d")], "k int, w string")
    hot = spark.createDataFrame([(7,)], "k int")
    for how in ("inner", "left"):
        same(salted_join(big, small, ["k"], how, hot, 5).toPandas(), big.join(small, "k", how).toPandas())
