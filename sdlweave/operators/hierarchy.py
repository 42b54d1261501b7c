"""Parent-child links to full hierarchies (problem 6).

Per collection the links form a directed graph. Roots are types to which no other type links. A breadth-
first search from all roots gives depth and root; the parent through which a type was first reached (the
smallest root, then the smallest name) makes a forest. Cycles are separated first, as strongly connected
components. On the forest a heavy-path decomposition by subtree sizes labels chains by their heads; chain and
subtree are intervals of the positions within a root. A path is the concatenation of its chains' segments and
is made only where it is asked for; the descendants of a node are the nodes of its root whose position lies in
``[pos, pos + subtree_size)``.

Collections whose nodes and links number at most ``BOUND`` rows (counted) are one block and are solved whole in one
grouped call each, in memory linear in the block. Larger ones go through joins that hold no group in one task and whose
rounds do not follow the depth: nodes with one way in are led to the first that has none or several by pointer doubling, subtree
sizes and positions are doubled along the tree, chains of nodes with one way in and out are spliced out before
cycles are looked for. What still takes a round each is a link between nodes with several ways in along a shortest path, and a
step inside a strongly connected core. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import md5
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sdlweave.functions.refs import base_type
from sdlweave.runtime import stage

#: Nodes and links of one collection that are solved in one task: lists of a few numbers for each, whatever the depth.
BOUND = 400_000
#: Pairs of the closure, and characters of paths, that leave a task at once.
PAIRS, PATH_CHARS = 100_000, 8 << 20
SEPARATOR = "/"
SCHEMA = "collection string, type_name string, root_name string, depth int, on_cycle int, parent_name string, chain string, pos int, subtree_size int"
PATHS = f"{SCHEMA}, path string"
CLOSURE = "collection string, type_name string, descendant string, distance int"
_NONE = "\x00"


def type_links(docs: DataFrame) -> DataFrame:
    """Distinct ``collection, src, dst``: a row per node with null ``dst``, and a row per candidate link.

    Null names are no types. A null collection is a collection of its own, written as null.
    """
    ref = lambda c: base_type(F.col(c))
    rows = docs.filter(F.col("type").isin("object", "interface", "union", "field")).select(
        "collection",
        F.explode(
            F.when(F.col("type") == "field", F.array(F.struct(ref("metadata.parentType").alias("src"), ref("metadata.fieldType").alias("dst"))))
            .when(F.col("type") == "union", F.concat(F.array(F.struct(F.col("name").alias("src"), F.lit(None).cast("string").alias("dst"))), F.coalesce(F.transform("metadata.possibleTypes", lambda x: F.struct(F.col("name").alias("src"), base_type(x).alias("dst"))), F.array().cast("array<struct<src:string,dst:string>>"))))
            .otherwise(F.array(F.struct(F.col("name").alias("src"), F.lit(None).cast("string").alias("dst"))))
        ).alias("l"),
        (F.col("type") == "field").alias("is_field"),
    )
    ok = F.col("src").isNotNull() & (~F.col("is_field") | F.col("dst").isNotNull())
    return rows.select("collection", "l.src", "l.dst", "is_field").filter(ok).select("collection", "src", "dst").distinct()


class Solved:
    """Root, depth, cycle flag, forest parent, chain head, position and subtree size of each node of one block, by number.

    ``names`` are sorted, so that the smaller number is the smaller name. Numbers of absent nodes are -1.
    """

    def __init__(self, names: list[str], links: list[tuple[int, int]]) -> None:
        n = len(names)
        self.names = names
        out: list[list[int]] = [[] for _ in range(n)]
        entered, loops = [False] * n, [False] * n
        for a, b in links:
            if a == b:
                loops[a] = True
            else:
                out[a].append(b)
                entered[b] = True
        self.cyclic = [x or y for x, y in zip(_components(out), loops)]
        self.root, self.depth, self.parent = [-1] * n, [-1] * n, [-1] * n
        root, depth, parent = self.root, self.depth, self.parent
        front = [v for v in range(n) if not entered[v]]
        for v in front:
            root[v], depth[v] = v, 0
        self.order, d = list(front), 0
        while front:
            d += 1
            best: dict[int, tuple[int, int]] = {}
            for u in front:
                for v in out[u]:
                    if depth[v] < 0 and (v not in best or (root[u], u) < best[v]):
                        best[v] = (root[u], u)
            front = sorted(best)
            for v in front:
                (root[v], parent[v]), depth[v] = best[v], d
            self.order += front
        self.size = [1 if d >= 0 else 0 for d in depth]
        self.pos, self.head = [-1] * n, [-1] * n

    def label(self) -> Solved:
        """Sizes, then positions in preorder within a root, the heavy child first: an interval per subtree and per chain.

        Root and depth of a node are read off its chain: those of the head, and the steps from there.
        """
        children: list[list[int]] = [[] for _ in self.names]
        for v in reversed(self.order):
            if (p := self.parent[v]) >= 0:
                self.size[p] += self.size[v]
                children[p].append(v)
        for v in self.order:
            if self.parent[v] < 0:
                self.pos[v], self.head[v] = 0, v
            some = children[v]
            if len(some) > 1:
                heavy = min(some, key=lambda c: (-self.size[c], c))
                some = [heavy, *sorted((c for c in some if c != heavy), key=lambda c: (_bucket(self.names[c]), c))]
            at = self.pos[v] + 1
            for i, c in enumerate(some):
                self.pos[c], self.head[c] = at, c if i else self.head[v]
                at += self.size[c]
        for v in self.order:
            if (h := self.head[v]) != v:
                self.root[v], self.depth[v] = self.root[h], self.depth[h] + self.pos[v] - self.pos[h]
        return self

    def name(self, v: int) -> str | None:
        return self.names[v] if v >= 0 else None

    def columns(self, numbers: range) -> list[list]:
        """The columns of ``SCHEMA`` but the first."""
        return [
            [self.names[v] for v in numbers],
            [self.name(self.root[v]) or "" for v in numbers],
            [self.depth[v] for v in numbers],
            [int(self.cyclic[v]) for v in numbers],
            [self.name(self.parent[v]) for v in numbers],
            [self.name(self.head[v]) for v in numbers],
            [self.pos[v] for v in numbers],
            [self.size[v] for v in numbers],
        ]

    def paths(self) -> Iterator[str | None]:
        """Each node's path from the segments of the chains above it; at most a logarithm of the nodes are joined."""
        chains: dict[int, list[str]] = {}
        for v in sorted((v for v in self.order), key=lambda v: (self.root[v], self.pos[v])):
            chains.setdefault(self.head[v], []).append(self.names[v])
        for v in range(len(self.names)):
            parts: list[str] = []
            u = v if self.depth[v] >= 0 else -1
            while u >= 0:
                h = self.head[u]
                parts.append(SEPARATOR.join(chains[h][: self.pos[u] - self.pos[h] + 1]))
                u = self.parent[h]
            yield SEPARATOR.join(reversed(parts)) if parts else None


def _bucket(name: str) -> str:
    return md5(name.encode("utf-8", "surrogatepass")).hexdigest()[:2]


def _components(out: list[list[int]]) -> list[bool]:
    """For each node whether its strongly connected component has more than one node."""
    n = len(out)
    index, low, on, big = [0] * n, [0] * n, [False] * n, [False] * n
    stack: list[int] = []
    count = 0
    for s in range(n):
        if index[s]:
            continue
        count += 1
        index[s] = low[s] = count
        stack.append(s)
        on[s] = True
        work = [(s, iter(out[s]))]
        while work:
            v, rest = work[-1]
            for w in rest:
                if not index[w]:
                    count += 1
                    index[w] = low[w] = count
                    stack.append(w)
                    on[w] = True
                    work.append((w, iter(out[w])))
                    break
                if on[w]:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on[w] = False
                        part.append(w)
                        if w == v:
                            break
                    if len(part) > 1:
                        for w in part:
                            big[w] = True
    return big


def _block(got: pa.Table) -> tuple[list[str], list[tuple[int, int]]]:
    src, dst = got["src"].to_pylist(), got["dst"].to_pylist()
    nodes = sorted({s for s, d in zip(src, dst) if d is None})
    at = {s: i for i, s in enumerate(nodes)}
    return nodes, sorted({(at[s], at[d]) for s, d in zip(src, dst) if d is not None and s in at and d in at})


_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _solver(paths: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(batches)
        collection = got["collection"][0].as_py()
        solved = Solved(*_block(got)).label()

        def batch(first: int, last: int, *more: pa.Array) -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(solved.columns(range(first, last)), _TYPES)]
            return pa.RecordBatch.from_arrays([pa.array([collection] * (last - first), pa.string()), *cols, *more], names=[*_NAMES, *(["path"] if more else [])])

        n, made = len(solved.names), []
        if not paths:
            for at in range(0, n, PAIRS):
                yield batch(at, min(n, at + PAIRS))
            return
        first = chars = 0
        for v, p in enumerate(solved.paths()):
            made.append(p)
            chars += len(p or "")
            if chars >= PATH_CHARS or v == n - 1:
                yield batch(first, v + 1, pa.array(made, pa.string()))
                first, made, chars = v + 1, [], 0

    return run


def hierarchy(docs: DataFrame, bound: int = BOUND) -> DataFrame:
    """One row per distinct collection and type name; columns as in ``SCHEMA``.

    ``chain`` names the head of the node's chain, ``pos`` counts within its root. A type that no root leads to has root '',
    depth -1, null parent and chain, position -1 and size 0.
    """
    few, many = _by_size(docs, bound)
    solved = few.groupBy("collection").applyInArrow(_solver(False), SCHEMA)
    return solved if many is None else solved.unionByName(_named(solve_distributed(many)))


def paths(docs: DataFrame, bound: int = BOUND) -> DataFrame:
    """:func:`hierarchy` with ``path``, the names from the root on; null where no root leads. Its length is the sum of depths."""
    few, many = _by_size(docs, bound)
    solved = few.groupBy("collection").applyInArrow(_solver(True), PATHS)
    return solved if many is None else solved.unionByName(_named(_joined_paths(stage(solve_distributed(many)))))


def _named(tree: DataFrame) -> DataFrame:
    return tree.withColumn("collection", F.when(F.col("_c") != _NONE, F.col("_c"))).drop("_c")


def _by_size(docs: DataFrame, bound: int) -> tuple[DataFrame, DataFrame | None]:
    """The links of the collections solved in one task (``collection, src, dst``) and of the larger ones (``_c, src, dst``)."""
    links = stage(type_links(docs))
    large = links.groupBy("collection").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bound).select(F.coalesce("collection", F.lit(_NONE)).alias("_c"))
    if large.isEmpty():
        return links, None
    marked = links.withColumn("_c", F.coalesce("collection", F.lit(_NONE))).join(stage(large).withColumn("_large", F.lit(True)), "_c", "left")
    return marked.filter(F.col("_large").isNull()).select("collection", "src", "dst"), marked.filter("_large").select(F.col("_c"), "src", "dst")


def _graph(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged ``_c, v`` of the nodes and distinct ``_c, src, dst`` between them."""
    nodes = stage(links.filter(F.col("dst").isNull()).select("_c", F.col("src").alias("v")).distinct())
    edges = links.filter(F.col("dst").isNotNull()).join(nodes.withColumnRenamed("v", "src"), ["_c", "src"], "left_semi").join(nodes.withColumnRenamed("v", "dst"), ["_c", "dst"], "left_semi")
    return nodes, stage(edges.select("_c", "src", "dst").distinct())


def solve_distributed(links: DataFrame) -> DataFrame:
    """The same as :class:`Solved` by joins; ``links`` has ``_c, src, dst`` with node rows as null ``dst``.

    Every round is staged, so no plan grows with the number of rounds.
    """
    nodes, edges = _graph(links)
    tree = _forest(nodes, stage(edges.filter(F.col("src") != F.col("dst"))))
    return (
        nodes.join(_label(tree), ["_c", "v"], "left")
        .join(on_cycle(edges).withColumn("on", F.lit(1)), ["_c", "v"], "left")
        .select("_c", F.col("v").alias("type_name"), F.coalesce("root", F.lit("")).alias("root_name"), F.coalesce("depth", F.lit(-1)).alias("depth"), F.coalesce("on", F.lit(0)).alias("on_cycle"), F.col("parent").alias("parent_name"), "chain", F.coalesce("pos", F.lit(-1)).cast("int").alias("pos"), F.coalesce("size", F.lit(0)).cast("int").alias("subtree_size"))
    )


def _jump(pointers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``_c, v, top, hops`` by pointer doubling over ``_c, v, up``: the first node upwards that has no pointer itself.

    Also ``_c, v`` of those that come to none, as they are on a ring of pointers or hang on one.
    """
    now = stage(pointers.select("_c", "v", F.col("up").alias("top"), F.lit(1).alias("hops"), F.lit(True).alias("open")))
    longest, step = now.count(), 1
    while step <= 2 * longest:
        far = now.select("_c", F.col("v").alias("top"), F.col("top").alias("top2"), F.col("hops").alias("hops2"), F.col("open").alias("open2"))
        moved = now.filter("open").join(far, ["_c", "top"], "left").select("_c", "v", F.coalesce("top2", "top").alias("top"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"), F.coalesce("open2", F.lit(False)).alias("open"))
        now = stage(now.filter("not open").unionByName(moved))
        step *= 2
        if now.filter("open").isEmpty():
            break
    return now.filter("not open").drop("open"), now.filter("open").select("_c", "v")


def _forest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Staged ``_c, v, root, parent, depth`` of the nodes that a root leads to."""
    ins = stage(edges.groupBy("_c", F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("up")))
    led, _ = _jump(ins.filter("n = 1").select("_c", "v", "up"))
    led = led.select("_c", "v", "top", "hops")
    several = ins.filter("n > 1").select("_c", F.col("v").alias("dst"))
    arcs = edges.join(several, ["_c", "dst"], "left_semi").join(led.withColumnRenamed("v", "src"), ["_c", "src"], "left")
    only = ins.filter("n = 1").select("_c", F.col("v").alias("src"), F.lit(True).alias("lost"))  # led nowhere: below a ring
    arcs = arcs.join(only, ["_c", "src"], "left").filter("top is not null or lost is null")
    arcs = stage(arcs.groupBy("_c", F.coalesce("top", "src").alias("a"), F.col("dst").alias("v")).agg((F.min(F.coalesce("hops", F.lit(0))) + 1).alias("w")))
    best = front = stage(nodes.join(ins.select("_c", "v"), ["_c", "v"], "left_anti").select("_c", "v", F.lit(0).alias("depth"), F.col("v").alias("root")))
    while not front.isEmpty():
        reached = front.select("_c", F.col("v").alias("a"), "depth", "root").join(arcs, ["_c", "a"]).groupBy("_c", "v").agg(F.min(F.struct((F.col("depth") + F.col("w")).alias("depth"), "root")).alias("b"))
        known = best.select("_c", "v", F.struct("depth", "root").alias("k"))
        front = stage(reached.join(known, ["_c", "v"], "left").filter("k is null or b < k").select("_c", "v", "b.depth", "b.root"))
        best = stage(best.join(front.select("_c", "v"), ["_c", "v"], "left_anti").unionByName(front))
    rest = led.join(best.select("_c", F.col("v").alias("top"), "depth", "root"), ["_c", "top"]).select("_c", "v", (F.col("depth") + F.col("hops")).alias("depth"), "root")
    reached = stage(best.unionByName(rest))
    above = reached.select("_c", F.col("v").alias("src"), (F.col("depth") + 1).alias("depth"), "root")
    parents = edges.join(above, ["_c", "src"]).select("_c", F.col("dst").alias("v"), "src", "depth", "root").join(reached, ["_c", "v", "depth", "root"], "left_semi").groupBy("_c", "v").agg(F.min("src").alias("parent"))
    return stage(reached.join(parents, ["_c", "v"], "left").select("_c", "v", "root", "parent", "depth"))


def _label(tree: DataFrame) -> DataFrame:
    """Adds subtree size, chain and position by doubling.

    The children of one parent are spread over 256 buckets: sums of buckets first, then within a bucket.
    """
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    now, step = stage(tree.select("_c", "v", "depth", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size"))), 1
    while step <= deepest:  # size: of the descendants nearer than step; up: the ancestor step links away
        below = now.filter(F.col("depth") >= step).groupBy("_c", F.col("up").alias("v")).agg(F.sum("size").alias("more"))
        far = now.filter(F.col("depth") >= step).select("_c", F.col("v").alias("up"), F.col("up").alias("up2"))
        deep = now.filter(F.col("depth") >= 2 * step).join(far, ["_c", "up"], "left").select("_c", "v", "depth", F.col("up2").alias("up"), "size")
        flat = now.filter(F.col("depth") < 2 * step).withColumn("up", F.lit(None).cast("string"))
        now = stage(deep.unionByName(flat).join(below, ["_c", "v"], "left").select("_c", "v", "depth", "up", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        step *= 2
    sized = stage(tree.join(now.select("_c", "v", "size"), ["_c", "v"]))
    below = sized.filter("depth > 0")
    heavy = below.groupBy("_c", "parent").agg(F.min(F.struct((-F.col("size")).alias("s"), F.col("v").alias("v"))).alias("h")).select("_c", "parent", F.col("h.v").alias("heavy"), (-F.col("h.s")).alias("h_size"))
    marked = stage(below.join(heavy, ["_c", "parent"]).withColumn("bucket", F.substring(F.md5(F.col("v").cast("binary")), 1, 2)))
    light = marked.filter("v <> heavy")
    ends = Window.unboundedPreceding, 0
    starts = light.groupBy("_c", "parent", "bucket").agg(F.sum("size").alias("b")).withColumn("start", F.sum("b").over(Window.partitionBy("_c", "parent").orderBy("bucket").rowsBetween(*ends)) - F.col("b"))
    within = F.sum("size").over(Window.partitionBy("_c", "parent", "bucket").orderBy("v").rowsBetween(*ends)) - F.col("size")
    late = light.withColumn("local", within).join(starts.select("_c", "parent", "bucket", "start"), ["_c", "parent", "bucket"]).select("_c", "v", "depth", F.col("parent").alias("up"), (F.col("h_size") + F.col("start") + F.col("local") + 1).alias("pos"))
    first = marked.filter("v = heavy").select("_c", "v", "depth", F.col("parent").alias("up"), F.lit(1).cast("long").alias("pos"))
    now, step = stage(late.unionByName(first)), 1
    while step <= deepest:  # pos: from the ancestor step links away, which is up
        far = now.select("_c", F.col("v").alias("up"), F.col("up").alias("up2"), F.col("pos").alias("pos2"))
        deep = now.filter(F.col("depth") > step).join(far, ["_c", "up"]).select("_c", "v", "depth", F.col("up2").alias("up"), (F.col("pos") + F.col("pos2")).alias("pos"))
        now = stage(now.filter(F.col("depth") <= step).unionByName(deep))
        step *= 2
    heads, _ = _jump(marked.filter("v = heavy").select("_c", "v", F.col("parent").alias("up")))
    placed = sized.join(now.select("_c", "v", "pos"), ["_c", "v"], "left").join(heads.select("_c", "v", F.col("top").alias("chain")), ["_c", "v"], "left")
    return stage(placed.withColumns({"pos": F.coalesce("pos", F.lit(0)), "chain": F.coalesce("chain", "v")}))


def _joined_paths(tree: DataFrame) -> DataFrame:
    """Paths by concatenating chain segments; a round for each light link on a path, so at most a logarithm of the nodes."""
    held = tree.filter("depth >= 0")
    names = F.transform(F.array_sort(F.collect_list(F.struct("pos", "type_name"))), lambda x: x["type_name"])
    chains = stage(held.groupBy("_c", "chain").agg(names.alias("names"), F.min("pos").alias("first")))
    part = lambda pos: F.slice("names", 1, (pos - F.col("first") + 1).cast("int"))
    heads = stage(held.filter("type_name = chain and depth > 0").select("_c", "chain", F.col("parent_name").alias("type_name")).join(held.select("_c", "type_name", F.col("chain").alias("on"), F.col("pos").alias("at")), ["_c", "type_name"]).select("_c", "chain", "on", "at"))
    front = stage(held.filter("depth = 0").select("_c", "chain", F.array().cast("array<string>").alias("prefix")))
    done = [front]
    while not front.isEmpty():
        above = front.join(chains, ["_c", "chain"]).withColumnRenamed("chain", "on")
        front = stage(heads.join(above, ["_c", "on"]).select("_c", "chain", F.concat("prefix", part(F.col("at"))).alias("prefix")))
        done.append(front)
    rows = held.select("_c", "type_name", "chain", "pos").join(reduce(DataFrame.unionByName, done), ["_c", "chain"]).join(chains, ["_c", "chain"])
    return tree.join(rows.select("_c", "type_name", F.array_join(F.concat("prefix", part(F.col("pos"))), SEPARATOR).alias("path")), ["_c", "type_name"], "left")


def on_cycle(edges: DataFrame) -> DataFrame:
    """``_c, v`` of the nodes from which links lead back.

    Links of nodes without a way in or out are dropped and nodes with one way in and one out are spliced out, in turn, so
    trees and chains vanish in a logarithm of rounds; the core is parted by forward-backward colouring. A node that was
    spliced out between two nodes of one component belongs to it.
    """
    found = [stage(edges.filter(F.col("src") == F.col("dst")).select("_c", F.col("src").alias("v")))]
    live = stage(edges.filter(F.col("src") != F.col("dst")))
    parts: list[DataFrame] = []  # _c, v, part
    spliced: list[DataFrame] = []  # _c, v, u, w
    before = -1
    while (count := live.count()) and count != before:
        before = count
        ins = live.groupBy("_c", F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("i"), F.min("src").alias("up"))
        outs = live.groupBy("_c", F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("o"), F.min("dst").alias("down"))
        both = stage(ins.join(outs, ["_c", "v"]))
        live = stage(live.join(both.select("_c", F.col("v").alias("src")), ["_c", "src"], "left_semi").join(both.select("_c", F.col("v").alias("dst")), ["_c", "dst"], "left_semi").select("_c", "src", "dst"))
        single = both.filter("i = 1 and o = 1").select("_c", "v", "up", "down")
        single = stage(single.join(live.select("_c", F.col("dst").alias("v")), ["_c", "v"], "left_semi").join(live.select("_c", F.col("src").alias("v")), ["_c", "v"], "left_semi"))
        if single.isEmpty():
            continue
        tops, ring = _jump(single.select("_c", "v", "up"))
        bottoms, _ = _jump(single.select("_c", "v", F.col("down").alias("up")))
        run = stage(tops.select("_c", "v", F.col("top").alias("u")).join(bottoms.select("_c", "v", F.col("top").alias("w")), ["_c", "v"]))
        spliced.append(run)
        parts.append(stage(ring.withColumn("part", F.lit(_NONE))))  # a ring of its own; nothing else leads into it
        parts.append(stage(run.filter("u = w").select("_c", F.col("u").alias("v"), F.col("u").alias("part")).distinct()))
        rest = live.join(single.select("_c", F.col("v").alias("src")), ["_c", "src"], "left_anti").join(single.select("_c", F.col("v").alias("dst")), ["_c", "dst"], "left_anti")
        live = stage(rest.select("_c", "src", "dst").union(run.filter("u <> w").select("_c", "u", "w")).distinct())
    core: list[DataFrame] = []
    while not live.isEmpty():
        ends = live.select("_c", F.col("src").alias("v")).union(live.select("_c", F.col("dst").alias("v"))).distinct()
        colour = _spread(live, stage(ends.withColumn("col", F.col("v"))))
        same = live.join(colour.select("_c", F.col("v").alias("src"), F.col("col").alias("cs")), ["_c", "src"]).join(colour.select("_c", F.col("v").alias("dst"), F.col("col").alias("cd")), ["_c", "dst"]).filter("cs = cd").select("_c", F.col("dst").alias("src"), F.col("src").alias("dst"))
        back = _reach(stage(same), colour.filter("v = col").select("_c", "v"))  # the component of each colour's name giver
        counted = back.join(colour, ["_c", "v"])
        core.append(stage(counted.join(counted.groupBy("_c", "col").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), ["_c", "col"], "left_semi").select("_c", "v", F.col("col").alias("part"))))
        left = ends.join(back, ["_c", "v"], "left_anti")
        live = stage(live.join(left.withColumnRenamed("v", "src"), ["_c", "src"], "left_semi").join(left.withColumnRenamed("v", "dst"), ["_c", "dst"], "left_semi"))
    if parts or core:
        # a part found in the core is the larger one, so it names the node
        some = [p.withColumn("rank", F.lit(r)) for r, group in enumerate((core, parts)) for p in group]
        known = stage(reduce(DataFrame.unionByName, some).groupBy("_c", "v").agg(F.min(F.struct("rank", "part")).alias("p")).select("_c", "v", "p.part"))
        for run in reversed(spliced):
            above, under = (known.select("_c", F.col("v").alias(x), F.col("part").alias(f"p{x}")) for x in "uw")
            held = run.join(above, ["_c", "u"]).join(under, ["_c", "w"]).filter("pu = pw").select("_c", "v", F.col("pu").alias("part"))
            known = stage(known.join(held.select("_c", "v"), ["_c", "v"], "left_anti").unionByName(held))
        found.append(known.select("_c", "v"))
    return reduce(DataFrame.union, found).distinct()


def _spread(live: DataFrame, colour: DataFrame) -> DataFrame:
    """Each node gets the largest name that leads to it."""
    while True:
        pushed = live.join(colour.withColumnRenamed("v", "src"), ["_c", "src"]).select("_c", F.col("dst").alias("v"), "col")
        new = stage(colour.withColumn("was", F.col("col")).unionByName(pushed, allowMissingColumns=True).groupBy("_c", "v").agg(F.max("col").alias("col"), F.max("was").alias("was")))
        colour = new.select("_c", "v", "col")
        if new.filter("col <> was").isEmpty():
            return colour


def _reach(links: DataFrame, start: DataFrame) -> DataFrame:
    seen = front = stage(start)
    while not front.isEmpty():
        front = stage(front.withColumnRenamed("v", "src").join(links, ["_c", "src"]).select("_c", F.col("dst").alias("v")).distinct().join(seen, ["_c", "v"], "left_anti"))
        seen = stage(seen.union(front))
    return seen


def descendants(tree: DataFrame) -> DataFrame:
    """``collection, type_name, descendant, distance``: the forest's closure, read off the intervals of positions.

    The rows number the sum of depths. Links outside the forest play no part here; :func:`all_descendants` follows all of them.
    """
    held = tree.filter("depth >= 0").select("collection", "root_name", "type_name", "depth", "pos", "subtree_size")
    inside = held.filter("subtree_size > 1").select(F.coalesce("collection", F.lit(_NONE)).alias("_c"), "root_name", "type_name", "depth", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + F.col("subtree_size") - 1)).alias("at"))
    spots = held.select(F.coalesce("collection", F.lit(_NONE)).alias("_c"), "root_name", F.col("pos").alias("at"), "collection", F.col("type_name").alias("descendant"), F.col("depth").alias("below"))
    return inside.join(spots, ["_c", "root_name", "at"]).select("collection", "type_name", "descendant", (F.col("below") - F.col("depth")).alias("distance"))


def reachable(links: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """``source, reached, distance`` over all links, source by source; a node never reaches itself."""
    out: dict[int, list[int]] = {}
    for a, b in links:
        if a != b:
            out.setdefault(a, []).append(b)
    for s in out:
        seen, front, d = {s}, [s], 0
        while front:
            d += 1
            after = []
            for u in front:
                for v in out.get(u, ()):
                    if v not in seen:
                        seen.add(v)
                        after.append(v)
                        yield s, v, d
            front = after


def _reach_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = pa.Table.from_batches(batches)
    collection = got["collection"][0].as_py()
    nodes, links = _block(got)
    pairs = reachable(links)
    while part := list(islice(pairs, PAIRS)):
        yield pa.RecordBatch.from_arrays(
            [pa.array([collection] * len(part), pa.string()), pa.array([nodes[a] for a, _, _ in part], pa.string()), pa.array([nodes[b] for _, b, _ in part], pa.string()), pa.array([d for _, _, d in part], pa.int32())],
            names=["collection", "type_name", "descendant", "distance"],
        )


def all_descendants(docs: DataFrame, bound: int = BOUND) -> DataFrame:
    """``collection, type_name, descendant, distance``: every other type that links lead to, and over how few.

    All links count, also those outside the forest and those of types that no root leads to. The rows can number
    the square of the types on one cycle; the grouped call holds the links of a collection and one source's search.
    """
    few, many = _by_size(docs, bound)
    if many is None:
        return few.groupBy("collection").applyInArrow(_reach_group, CLOSURE)
    _, edges = _graph(many)
    edges = edges.filter("src <> dst")
    seen = front = stage(edges.select("_c", F.col("src").alias("a"), F.col("dst").alias("v"), F.lit(1).alias("distance")))
    d = 1
    while not front.isEmpty():  # a pair is taken in the round of its distance, so each is extended once
        d += 1
        further = front.select("_c", "a", F.col("v").alias("src")).join(edges, ["_c", "src"]).select("_c", "a", F.col("dst").alias("v")).filter("a <> v").distinct()
        front = stage(further.join(seen.select("_c", "a", "v"), ["_c", "a", "v"], "left_anti").withColumn("distance", F.lit(d)))
        seen = stage(seen.unionByName(front))
    return few.groupBy("collection").applyInArrow(_reach_group, CLOSURE).unionByName(_named(seen).select("collection", F.col("a").alias("type_name"), F.col("v").alias("descendant"), "distance"))
