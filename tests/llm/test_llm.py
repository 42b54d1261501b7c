"""The llm operators against brute force, on fixtures with the awkward cases, and against their SQL."""

import math
import random
import re

import numpy as np
import pytest
from helpers import same
from hypothesis import given, settings
from hypothesis import strategies as st

from sdlweave.llm import containers as C
from sdlweave.llm import near_duplicates as D
from sdlweave.llm import pieces as P
from sdlweave.llm import queries
from sdlweave.llm import spam as S
from sdlweave.llm import tokens as T
from sdlweave.llm import vector_neighbors as V


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, data, duck):
    got = queries.QUERIES[name](spark, data)
    if name in queries.SQL:
        same(got.toPandas(), duck.sql(queries.SQL[name]).df())
    else:
        got.count()


# -- near duplicates ----------------------------------------------------------------------------
def words(text):
    return frozenset(w.lower() for w in re.findall(r"[A-Za-z0-9_]+", text or ""))


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


@settings(max_examples=60, deadline=None)
@given(st.integers(12, 400), st.randoms(use_true_random=False))
def test_every_pair_within_the_radius_collides(n, rnd):
    a = rnd.sample(range(1, 10**6), n)
    out = rnd.randint(0, n // 5)
    into = rnd.randint(0, max(0, n - out - math.ceil(0.8 * n) + (n - out) // 9))
    b = a[out:] + [10**6 + i for i in range(into)]
    if len(b) < 12 or not similar(set(a), set(b)):
        return
    mix = lambda s: np.sort(D._mix(np.array(s, dtype=np.uint64), 99))
    sets = [mix(a), mix(b)]
    sizes = np.array([len(s) for s in sets])
    keys, owner = D.signatures(np.concatenate(sets), np.array([0, sizes[0]]), sizes)
    assert set(keys[owner == 0]) & set(keys[owner == 1])
    sk = D.sketches(np.concatenate(sets), np.array([0, sizes[0]]), sizes)
    assert bin(int(sk[0] ^ sk[1]) & ((1 << 52) - 1)).count("1") * 9 <= sizes.sum()


def type_rows(rnd, n):
    vocabulary = [f"word{i}" for i in range(60)] + ["String", "ID", "type"]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.choice([10, 16, 30, 80]))] for _ in range(12)]
    out = []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 6])):
            w[rnd.randrange(len(w))] = f"new{rnd.randrange(500)}"
        rnd.shuffle(w)
        out.append((i, rnd.choice(["object", "input", "enum", "interface", "object", "field", None]), rnd.choice([" ", ", ", "\t:"]).join(w)))
    return out + [(n, "object", None), (n + 1, "object", ""), (n + 2, "object", " ".join(f"v{i}" for i in range(30_000))), (n + 3, "object", " ".join(f"v{i}" for i in range(5, 30_000))), (n + 4, "object", "K " * 40), (None, "object", " ".join(f"v{i}" for i in range(40)))]


@pytest.mark.parametrize("hot", [False, True])
def test_near_duplicates_brute_force(spark, monkeypatch, hot):
    if hot:  # every key that two sets share counts as hot
        monkeypatch.setattr(D, "HOT_ROWS", 2)
        monkeypatch.setattr(D, "BLOCK_ROWS", 1)
        monkeypatch.setattr(D, "HOT_COPIES", 2)
    data = type_rows(random.Random(3), 250)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in data], "row_id long, type string, content string, rep int, words int, sig int")
    sets = [(i, words(c)) for i, t, c in data if t in D.TYPES and i is not None]
    sets = [(i, s) for i, s in sets if len(s) >= 12]
    want = {(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[k + 1 :] if similar(a, b)}
    got = [tuple(r) for r in D.similar_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    g = {r["row_id"]: r for r in D.groups(df).collect()}
    assert set(g) == {i for i, _ in sets}
    of = dict(sets)
    for i, j in want:
        assert g[i]["group_id"] == g[j]["group_id"]
    for i in g:
        assert g[i]["class_id"] == min(j for j in of if of[j] == of[i])
        assert g[i]["n_links"] == len({of[j] for j in of if of[j] != of[i] and similar(of[i], of[j])})
    assert D.similar_pairs(df.limit(0)).count() == 0 == D.groups(df.limit(0)).count()


# -- neighbours ---------------------------------------------------------------------------------
def brute_neighbours(rows, least=0.85, every=1):
    ok = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v in rows if i is not None and v is not None and len(v) == 64 and None not in v and np.isfinite(np.array(v, dtype=np.float32)).all() and any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in ok])
    s = np.round(x @ x.T, 9)
    out = set()
    for k, (i, _) in enumerate(ok):
        near = sorted(((-s[k, m], j) for m, (j, _) in enumerate(ok) if m != k and s[k, m] >= least))[:10] if i % every == 0 else []
        out |= {(i, j) for _, j in near}
    return out


def vector_rows(seed, n=1500, copies=30):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((25, 64))
    rows = []
    for i in range(n):
        c = centres[rng.integers(25)] if rng.random() < 0.8 else rng.standard_normal(64)
        v = (c + rng.standard_normal(64) * rng.choice([0.05, 0.3, 0.5])).astype(np.float32)
        rows.append((i, [float(x) for x in v]))
    rows += [(n + i, rows[5][1]) for i in range(copies)] + [(2 * n + i, [x * 4 for x in rows[5][1]]) for i in range(3)]
    rows += [(9000, None), (9001, [0.0] * 64), (9002, [1.0] * 32), (9003, [float("nan")] * 64), (9004, [float("inf")] + [1.0] * 63), (9005, [None] + [1.0] * 63), (None, rows[5][1])]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_neighbours_brute_force(spark, monkeypatch, small):
    if small:  # several groups, blocks and portions; prototypes from a part of the rows
        for k, v in {"GROUP_ROWS": 200, "BLOCK_ROWS": 150, "PORTION": 100, "SAMPLE": 400}.items():
            monkeypatch.setattr(V, k, v)
    rows = vector_rows(1)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "stored_id long, embedding array<float>, vid int, cell int")
    got = {(r["vid"], r["other"]) for r in V.neighbours(df).collect()}
    want = brute_neighbours(rows)
    assert len(got & want) >= 0.999 * len(want) and len(got) <= len(want)
    pairs = [tuple(r) for r in V.neighbour_pairs(df).collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
    assert len({(min(p), max(p)) for p in want} - set(pairs)) <= 0.001 * len(pairs)


@pytest.mark.parametrize("small", [False, True])
def test_search_brute_force(spark, monkeypatch, small):
    if small:
        for k, v in {"GROUP_ROWS": 200, "BLOCK_ROWS": 150, "PORTION": 100, "SAMPLE": 400}.items():
            monkeypatch.setattr(V, k, v)
    rows = vector_rows(3, 1200, 20)
    df = spark.createDataFrame(rows, "stored_id long, embedding array<float>")
    got = {(r["vid"], r["other"]) for r in V.search(df, 10).collect()}
    want = brute_neighbours(rows, -2, 10)
    assert len(got) == len(want) and len(got & want) >= 0.999 * len(want)
    assert V.search(df.limit(0)).count() == 0


def test_neighbours_of_mostly_isolated_vectors(spark, monkeypatch):
    """Far more clusters than prototypes: most rows are outer rows."""
    monkeypatch.setattr(V, "SAMPLE", 300)
    monkeypatch.setattr(V, "BLOCK_ROWS", 700)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((1600, 64))
    x = np.concatenate([base, base[:500] + rng.standard_normal((500, 64)) * 0.35]).astype(np.float32)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "stored_id long, embedding array<float>")
    want, got = brute_neighbours(rows), {(r["vid"], r["other"]) for r in V.neighbours(df).collect()}
    assert len(want) > 900 and len(got & want) >= 0.99 * len(want) and got <= want


def test_the_stop_ends_most_of_the_search():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    centres = rng.standard_normal((200, 64))
    x = (np.repeat(centres, 10, axis=0) + rng.standard_normal((2000, 64)) * 0.3).astype(np.float32)
    t = pa.table({"vid": np.arange(2000), "vec": pa.array(list(x), pa.list_(pa.float32())), "cell": np.repeat(np.arange(200), 10).astype(np.int32), "inner": pa.array([True] * 2000)})
    b = V.Block(t)
    hits = sum(len(r) for _, r, _, _ in b.search(b.x, b.p, b.ids, True))
    assert hits >= 2000 * 9 * 0.8 and b.stopped > 0.75 * b.tested and b.kept <= 0.02 * b.tested


@pytest.mark.parametrize("sample", [300])
def test_many_outer_rows_are_sent_a_bounded_number_of_times(spark, monkeypatch, sample):
    """Levels of prototypes and then tables, where blocks of outer rows would meet one another."""
    for k, v in {"SAMPLE": sample, "BLOCK_ROWS": 200}.items():
        monkeypatch.setattr(V, k, v)
    sent, place = [], V.Index.place
    monkeypatch.setattr(V.Index, "place", lambda self, routed: sent.append((self, routed)) or place(self, routed))
    rng = np.random.default_rng(6)
    base = rng.standard_normal((700, 64))
    x = np.concatenate([base, np.repeat(base[:150], 8, axis=0) + rng.standard_normal((1200, 64)) * 0.35]).astype(np.float32)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "stored_id long, embedding array<float>")
    want, got = brute_neighbours(rows), {(r["vid"], r["other"]) for r in V.neighbours(df).collect()}
    assert len(got & want) >= 0.995 * len(want) and len(got) <= len(want)
    assert [i.outer > V.BLOCK_ROWS for i, _ in sent] == [True, True]  # the rest is dealt to tables


def test_tables_miss_a_close_pair_as_seldom_as_the_stop():
    rng = np.random.default_rng(8)
    for spread in (1.0, 0.5):  # the second lies in a cone
        x = rng.standard_normal((4000, 64)) * spread / 8
        x[:, 0] += 1 - spread
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        e = rng.standard_normal((4000, 64))
        e -= (e * x).sum(1, keepdims=True) * x
        y = 0.85 * x + math.sqrt(1 - 0.85**2) * e / np.linalg.norm(e, axis=1, keepdims=True)
        missed = np.ones(4000, bool)
        for d, cuts in V.tables(200_000, x):
            missed &= ((x @ d > cuts) != (y @ d > cuts)).any(1)
        assert missed.mean() <= 0.003


@pytest.mark.parametrize("few", [True, False])
def test_copies_get_cut_lists(spark, monkeypatch, few):
    """A list is cut before each of the copies gets it: K entries a row, whatever the neighbours' own copies."""
    if not few:
        monkeypatch.setattr(V, "BROADCAST_ROWS", 0)
    copies = spark.createDataFrame([(k, k + 10 * i) for k in range(10) for i in range(30)], "rep long, vid long")
    lists = spark.createDataFrame([(a, b, 0.9) for a in range(10) for b in range(10) if a != b] + [(900, 1, 0.9)], "vid long, other long, sim double")
    got = V.lists_of_copies(lists, copies)
    assert got.count() == V.K * 301
    assert {(r["other"], r["sim"]) for r in got.filter("vid = 40").collect()} == {(10 * i, 1.0) for i in range(11) if i != 4}


@pytest.mark.parametrize("few", [True, False])
def test_neighbours_of_a_hot_group_and_of_nothing(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(V, "BROADCAST_ROWS", 0)
    rows = vector_rows(2, 60, 400)
    df = spark.createDataFrame(rows, "stored_id long, embedding array<float>")
    assert {(r["vid"], r["other"]) for r in V.neighbours(df).collect()} == brute_neighbours(rows)
    assert V.neighbour_pairs(df.limit(0)).count() == 0 == V.neighbour_pairs(df.filter("stored_id >= 9000")).count()


def test_chi_square():
    for p, x in ((0.5, 23.337), (0.95, 36.415), (0.99, 42.980)):
        assert abs(V.chi2_quantile(p, 24) - x) < 0.01


# -- pieces -------------------------------------------------------------------------------------
notes = st.sampled_from(["", '"a } b { c" ', '"""block: (x) {y} "q" """', '"q \\"in\\" q"', "# } comment\n"])
member = st.builds(lambda d, n, a, t, v, x: f"{d}{n}{a}{t}{v}{x}", notes, st.from_regex(r"[a-z][A-Za-z0-9_]{0,20}", fullmatch=True), st.sampled_from(["", "(a:Int=1)", '(a:String="):{" b:[Int!]!={k:[1 "}"]})']), st.sampled_from([":Int", ":[[A!]]!", ":B!"]), st.sampled_from(["", "=1", '="x{y}"', "={a:[1,2]}", "=null"]), st.sampled_from(["", "@d", '@d(r:"}")@e', "@auth(rule:{role:\"c\" any:[1 2]})"]))


@settings(max_examples=150, deadline=None)
@given(st.lists(member, min_size=1, max_size=30), st.sampled_from(["type T{", '"d { x" type T implements A & B @k(f:{a:"{"}) {', "input I {", "interface N\n{"]), st.sampled_from([" ", "\n  ", ", "]), st.integers(60, 400))
def test_members_and_packing(ms, head, gap, limit):
    text = head + gap + gap.join(ms) + gap + "}"
    header, spans = P.members(text)
    assert text[:header] == head
    assert [P.tokens(text[a:b]) and [t[1] for t in P.tokens(text[a:b])] for a, b in spans] == [[t[1] for t in P.tokens(m)] for m in ms]
    got = P.greedy(text, limit)
    size = lambda a, b: header + spans[b][1] - spans[a][0] + 1
    if any(size(i, i) > limit for i in range(len(spans))):
        assert got == []
    else:
        want, first = [], 0
        while True:
            last = first
            while last + 1 < len(spans) and size(first, last + 1) <= limit:
                last += 1
            want.append((first, last))
            if last + 1 == len(spans):
                break
            first = last if size(last, last + 1) <= limit else last + 1
        assert got == want
    for fill in (0.5, 0.9):
        pieces = P.split(text, limit, fill)
        assert all(len(p) <= limit for _, _, p in pieces)
        if len(text) > limit and pieces[0][0] >= 0:
            assert sorted({m for a, b, _ in pieces for m in range(a, b + 1)}) == list(range(len(spans)))


def test_pieces_of_odd_rows(spark):
    shape = "row_id long, type string, content string, piece_no int, metadata struct<chunkIndex:int>"
    enum = "enum E{" + " ".join(f"VALUE_{i}" for i in range(400)) + "}"
    rows = [(1, "enum", enum, 0, (None,)), (2, "enum", enum, 0, (3,)), (3, "object", None, 0, None), (4, "object", "", 0, None), (5, "object", "type A{" + "x" * 3000, 0, None), (6, "object", 'type A{a:Int "' + "y " * 2000 + '"b:Int c:Int}', 0, None), (7, "field", "A.b:" + "long " * 900, 0, None), (8, None, "z" * 5000, 0, None), (9, "enum", enum.replace("VALUE", "ÜNI"), 0, None)]
    df = spark.createDataFrame(rows, shape)
    found = P.found_pieces(df).collect()
    assert {r["row_id"] for r in found} == {1}
    whole = P.pieces(df)
    assert {r["row_id"] for r in whole.collect()} == {1, 5, 6, 7, 8, 9}
    assert whole.filter("length(piece) > 2000 or chunkIndex >= totalChunks").count() == 0
    assert P.found_pieces(df.limit(0)).count() == 0 == P.pieces(df.limit(0)).count()


def test_valleys_of_even_members_take_linear_time():
    assert max(P.valleys(["x"] * 100_000)) < 1e-9


def test_valleys_mark_topics():
    parts = [f"order{w}" for w in ("Id", "Total", "Buyer", "State")] + [f"weather{w}" for w in ("Wind", "Rain", "Sun", "Snow")]
    depth = P.valleys(parts)
    assert depth.index(max(depth)) == 3


# -- tokens -------------------------------------------------------------------------------------
texts = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sd1é漢🚢<|>")), max_size=600)


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, min_size=1, max_size=8).map("".join), st.integers(120, 400))
def test_stitched_ids_equal_whole_ids(text, chunk):
    places, out, before = T.cuts(text, chunk, 100), [], None
    for n, (start, end) in enumerate(places):
        head = places[n - 1][1] - start if n else 0
        tail = places[n + 1][0] - start if n + 1 < len(places) else end - start
        marks, counts, meet, ids = T.encode_chunk(text[start:end], head, tail)
        out.append(ids[(counts[marks.index(before)] if before else 0) if before is not None else 0 :])
        before = meet
    got = np.concatenate(out).tolist()
    assert got == T.encode(text).tolist() and T.decode(got) == text.encode()


@pytest.mark.parametrize("text", ["!\x1c" * 30_000, "word " * 9000 + "\x1c\x1d\x1e\x1f" * 3000 + " word" * 9000, "a\x85b \x1d\x1e " * 20_000, "x\u0378 !" * 30_000, "tail\x1c \x1c" * 12_000])
def test_separators_that_are_no_space_to_the_pattern(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for chunk in (T.CHUNK, 1000):
        assert T.token_ids(df, chunk=chunk).first()["ids"] == T.encode(text).tolist()
    assert T.token_counts(df).first()["n"] == len(T.encode(text))


def test_white_space_is_that_of_the_pattern():
    import regex

    assert T.SPACES == {chr(c) for c in range(0x110000) if regex.fullmatch(r"\s", chr(c))}


def test_ids_of_a_table(spark):
    long = "def f(x):\n    return x  # naïve\n" * 3000
    rows = [(1, None), (2, ""), (3, "a <|endoftext|> b"), (4, long), (5, "x" * 90_000), (6, " " * 70_000), (4, long)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, ids int, chunk_no int").filter("doc_id <> 4").union(spark.createDataFrame([(4, long, 0, 0)], "doc_id long, text string, ids int, chunk_no int"))
    got = {r["doc_id"]: r["ids"] for r in T.token_ids(df).collect()}
    assert got[1] == [] == got[2] and all(T.decode(got[i]).decode() == t for i, t in rows if t)
    assert all(got[i] == T.encode(t).tolist() for i, t in rows if t)
    assert {r["doc_id"]: r["n"] for r in T.token_counts(df).collect()} == {k: len(v) for k, v in got.items()}
    assert T.token_ids(df.limit(0)).count() == 0
    twins = spark.createDataFrame([(7, long), (7, long), (None, long), (None, "short"), (None, long + "x")], "doc_id long, text string")
    lengths = sorted(len(r["ids"]) for r in T.token_ids(twins).collect())
    assert lengths == sorted(len(T.encode(t)) for t in (long, long, long, "short", long + "x"))


def test_other_library_gives_the_same_ids():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(T.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    for text in ("hello  world\n\n\n x's 12,5", "漢字🚢 naïve\r\n\tq", "<|endoftext|>", "   ", "ﬁ ²"):
        assert t.encode(text, add_special_tokens=False).ids == T.encode(text).tolist()


# -- containers ---------------------------------------------------------------------------------
@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=30))
def test_plan_fills_every_container(counts):
    rows, total = C.plan(counts, 64)
    fill, placed = [0] * total, dict.fromkeys(counts, 0)
    for size, first, container, per in rows:
        later = [f for s, f, _, _ in rows if s == size and f > first]
        for i in range(min(later, default=counts[size]) - first):
            fill[container + i // per] += size
            placed[size] += 1
    assert placed == counts and all(0 < f <= 64 for f in fill)
    least = max(math.ceil(sum(s * n for s, n in counts.items()) / 64), sum(n for s, n in counts.items() if s > 32))
    assert total <= 1.5 * least + 1


def test_containers_hold_every_item_once(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([0, 1, 100, 100, 700, 1500, 2048, 2049, 9000])) for i in range(900)] + [(1000 + i, 300) for i in range(600)]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, n int, size int, bucket int")
    got = C.pack(df).toPandas()
    back = got.groupby("doc_id")["n_tokens"].sum()
    assert all(back[i] == n for i, n in rows) and not got.duplicated(["doc_id", "piece_no"]).any()
    fill = got.groupby("container")["n_tokens"].sum()
    assert fill.max() <= 2048 and len(fill) <= math.ceil(sum(n for _, n in rows) / 2048) * 1.12
    assert set(fill.index) == set(range(len(fill)))
    assert all(len(g) == 1 for _, g in got[got.doc_id.isin([i for i, n in rows if n <= 2048])].groupby("doc_id"))
    assert C.pack(df.limit(0)).count() == 0


def test_repeated_words_with_stops_are_prose_to_the_density(spark):
    """The same words in short sentences: redundant, but not poor in punctuation."""
    rnd = random.Random(8)
    line = lambda: " ".join(rnd.choice(["kettle", "raft", "harbor", "mirror"]) for _ in range(5)) + "."
    rows = [(1, added("a.md", [line() for _ in range(30)]), "en")] + [(10 + i, HEAD + "".join(f"    {line()}\n" for _ in range(9)), "en") for i in range(40)]
    assert S.spam(spark.createDataFrame(rows, "doc_id long, text string, lang string")).count() == 0


# -- spam ---------------------------------------------------------------------------------------
HEAD = "commit 1a545a4ea95f51c938aa742b1d2db39fbe400684\nAuthor: a <a@b.invalid>\nDate:   2024-10-04 17:39:41 +0000\n\n    Update\n\n"
FILE = "diff --git a/{0} b/{0}\nnew file mode 100644\nindex 0000000..521deb3\n--- /dev/null\n+++ b/{0}\n@@ -0,0 +1,9 @@\n"


def added(name, lines):
    return HEAD + FILE.format(name) + "".join(f"+{x}\n" for x in lines)


def test_spam_and_what_only_looks_like_it(spark):
    rnd = random.Random(6)
    goods, sells = ["red kettle", "oak raft"], ["cheap", "buy", "best", "free shipping", "near me", "price", "coupon", "review"]
    pair = lambda: " ".join(rnd.sample([rnd.choice(sells), rnd.choice(goods)], 2))
    host = lambda: f"{rnd.choice('abc')}{rnd.randrange(999)}-deals.example"
    tag = lambda: "#" + "".join(w.capitalize() for w in pair().split())
    hide = lambda s: " ".join(rnd.choice([w.upper(), ".".join(w), "​".join(w)]) for w in s.split())
    spam = [
        added("a.md", [", ".join(pair() for _ in range(6)) for _ in range(10)]),
        added("a.md", [hide(" ".join(pair() for _ in range(6))) for _ in range(10)]),
        added("a.md", [f"* [{pair()}](http://{host()}/x{i})" for i in range(12)]),
        added("a.html", [f'<a href="https://{host()}/{i}">{pair()}</a><br>' for i in range(12)]),
        added("a.md", [" ".join(tag() for _ in range(6)) for _ in range(8)]),
        HEAD + "".join(f"    http://www.{host()}/q?ref={i}\n" for i in range(12)),
        added("a.md", ["Tags: " + ", ".join(pair() for _ in range(8)) for _ in range(6)] + ["Our kettle is always paid."]),
    ]
    nouns = ["".join(rnd.choice(["ba", "ke", "ot", "va", "mi", "lu", "ne", "ro", "sti", "gra"]) for _ in range(rnd.choice([2, 3, 4]))) for _ in range(300)]
    prose = lambda: "The " + " ".join(rnd.choice(nouns) for _ in range(rnd.choice([6, 9, 12]))) + "."
    fine = [
        added("CHANGELOG.md", [f"- {prose()} ([#{i}](https://forge.invalid/x/pull/{i}))" for i in range(15)]),
        added("words.txt", [rnd.choice(nouns) for _ in range(80)]),
        added("run.log", [f"2024-01-{i + 10} 05:58 WARN kernel ready kernel retry={i} kernel" for i in range(15)]),
        added("codes.ts", [f"  KETTLE_{n.upper()} = {i}," for i, n in enumerate(nouns)]),
        added("deps.lock", [x for i in range(12) for x in (f"kettle-{i}@^1.2.3:", f'  resolved "https://registry.invalid/k/-/k-1.2.{i}.tgz#e8be5c68d5ed{i}"', "  integrity sha-QFDN=")]),
        added("links.md", [x for i in range(8) for x in (f"### [Guide {nouns[i]}](https://docs.{nouns[i]}.invalid/start)", "", prose() + " " + prose())]),
        added("notes.md", [f'A title should name the {n} once; a list such as "cheap {n}" does more harm than good.' for n in nouns[:20]]),
        added("a.py", [f"    if not {n} or {n}.barrel is None:" for n in nouns]),
        added("README.md", [prose() for _ in range(20)] + ["#kettle #raft", "buy red kettle near me"]),
        HEAD + "    " + prose() + "\n",
    ]
    rows = [(i, t, "en") for i, t in enumerate(spam)] + [(100 + i, t, " EN-us") for i, t in enumerate(fine)]
    rows += [(1000 + i, HEAD + "".join(f"    {prose()}\n" for _ in range(rnd.choice([2, 6, 14, 40]))), None) for i in range(120)]
    rows += [(5000, None, "en"), (5001, "", None), (5002, " \n\t ", "de"), (5003, "x" * 500_000, "en"), (5004, spam[0], "fr"), (5005, spam[2].replace("\n", "\r\n"), "en")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, body int, redundancy int")
    got = sorted(r["doc_id"] for r in S.spam(df).collect())
    assert got == [*range(len(spam)), 5004, 5005]
    assert S.spam(df.limit(0)).count() == 0 and S.spam(df.filter("text is null")).count() == 0


def test_a_third_of_spam_does_not_move_the_usual_ratio(spark):
    rnd = random.Random(7)
    page = lambda: added("a.md", [", ".join(f"{rnd.choice(['cheap', 'buy', 'best'])} {rnd.choice(['red kettle', 'oak raft'])}" for _ in range(6)) for _ in range(10)])
    line = lambda: " ".join(rnd.choice(["harbor", "kettle", "ottoman", "valve", "mirror", "moves", "keeps", "holds", "north", "under", "while", "seven"]) + rnd.choice("abcdefgh") for _ in range(9)) + "."
    rows = [(i, page() if i % 3 == 0 else HEAD + "".join(f"    {line()}\n" for _ in range(12)), "en") for i in range(120)]
    got = sorted(r["doc_id"] for r in S.spam(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect())
    assert got == [i for i in range(120) if i % 3 == 0]


def test_language_factor_has_no_switch():
    got = [S._factor(0.6, n) for n in range(0, 5000)]
    assert got[0] == 1 and abs(got[-1] - 0.6) < 0.01
    assert all(0 <= a - b < 0.005 for a, b in zip(got, got[1:]))


def test_only_a_signature_ends_a_diff():
    diff = "subject\n\n@@ -1,3 +1,3 @@\n-a\n--\n+one\n+two\n"
    assert [x for x, new in S.body(diff) if new][-2:] == ["one", "two"]
    assert S.body(diff + "-- \n2.39.1\n") == S.body(diff) == S.body(diff + "--\n2.39.1 (x)\n\n")
    assert S.body(diff + "--\n2.39.1\n@@ -9 +9 @@\n+three\n")[-1] == ("three", True)


def test_a_first_piece_of_one_member_is_shared():
    spans = [(0, 55), (56, 70), (71, 85), (86, 99), (100, 140)]
    got = P.pack(5, spans, 100, 0.5, [9.0, 0.0, 0.0, 1.0])
    assert got[0] == (0, 0) and got[-1][1] == 4
    for (_, last), (first, end) in zip(got, got[1:]):
        assert first == last < end  # these fit together everywhere
    assert P.pack(5, [(0, 90), (91, 99)], 98, 0.5, [1.0]) == [(0, 0), (1, 1)]

