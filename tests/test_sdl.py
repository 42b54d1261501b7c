import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sdlweave.functions import text as X
from sdlweave.sdl import documents as D
from sdlweave.sdl import lexer as L
from sdlweave.sdl.parser import parse


def java_hash(s):
    h = 0
    u = s.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(u), 2):
        h = (31 * h + int.from_bytes(u[i : i + 2], "little")) % 2**32
    return abs(h - 2**32 if h >= 2**31 else h)


@given(st.text())
def test_content_id(s):
    assert int(D.content_id(s), 36) == java_hash(s)


def test_content_id_in_the_jvm(spark):
    texts = ["", "a", "héllo", "漢字", "🚢 x", "polygenelubricants", "x" * 100_000]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", X.content_id(df_col("t")).alias("id"))
    for r in df.collect():
        assert r["id"] == (D.content_id(r["t"]) if r["t"] is not None else None)


def df_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_compact():
    assert L.compact("type  A {\n # c\n a : [Int!]! , b(x:Int=1):String }") == "type A{a:[Int!]!b(x:Int=1):String}"
    assert L.compact('"""\n  two\n    lines\n"""\ntype A { a: Int }') == '"""\ntwo\n  lines""" type A{a:Int}'
    assert L.compact("{ a ...on B { c } ... { d } }") == "{a ...on B{c}...{d}}"
    assert L.compact('{ a(s: "#, {") }') == '{a(s:"#, {")}'


names = st.from_regex(r"[a-z][A-Za-z0-9_]{0,8}", fullmatch=True)
types = st.recursive(st.sampled_from(["Int", "String", "Other"]), lambda t: st.one_of(t.map(lambda x: f"[{x}]"), t.map(lambda x: x if x.endswith("!") else x + "!")), max_leaves=3)
values = st.sampled_from(["1", '"a:b(c}"', "true", "null", "[1 2]", '{k:"v" d:E}', "X"])
notes = st.sampled_from(["", '"plain" ', '"a } b { c" ', '"""block: (x) {y}""" ', '"q \\"in\\" q" '])


@st.composite
def sdl_types(draw):
    out = []
    for n in draw(st.lists(names, min_size=1, max_size=12)):
        args = draw(st.lists(st.tuples(names, types, st.one_of(st.none(), values)), max_size=2))
        inside = " ".join(f"{a}:{t}" + (f"={v}" if v else "") for a, t, v in args)
        out.append(f"{draw(notes)}{n}{f'({inside})' if args else ''}:{draw(types)}{draw(st.sampled_from(['', '@deprecated', '@tag(name:"x{y}")']))}")
    return "type T implements N @auth(rule:{role:\"r\"}){" + " ".join(out) + "}", len(out)


@settings(max_examples=150, deadline=None)
@given(sdl_types(), st.integers(30, 200))
def test_chunks_lose_nothing(made, limit):
    text, n = made
    text = L.compact(text)
    header, parts = D.members(text)
    assert len(parts) == n and header + "".join(parts) + "}" == text
    doc = {"id": D.content_id(text), "type": "object", "name": "T", "description": None, "content": text, "metadata": {}}
    chunks = D.chunk(doc, limit)
    assert "".join(c["content"][len(header) : -1] for c in chunks) == text[len(header) : -1]
    if len(chunks) > 1:
        assert [c["metadata"]["chunkIndex"] for c in chunks] == list(range(len(chunks)))
        assert {c["metadata"]["totalChunks"] for c in chunks} == {len(chunks)}
        assert all(c["content"].startswith(header) and c["content"].endswith("}") for c in chunks)
    assert L.compact(text) == text and len(parse(text)) == 1


def test_fields_and_unions_are_never_cut():
    for kind, text in (("field", "A.b:" + "X" * 300), ("union", "union U=" + "|".join(f"T{i}" for i in range(99)))):
        assert len(D.chunk({"type": kind, "content": text, "metadata": None}, 50)) == 1


def test_syntax_problem_has_a_place():
    with pytest.raises(L.SyntaxProblem) as e:
        parse("type A {\n  b: }")
    assert (e.value.line, e.value.column) == (2, 6)
    for bad in ("", "type", '"open', "type A { a Int }", "{", "type A implements { a: Int }"):
        with pytest.raises(L.SyntaxProblem):
            parse(bad)


def test_source_texts_that_are_null_blank_or_broken_give_no_rows(spark):
    df = spark.createDataFrame([("a", None), ("b", "  "), ("c", "type {"), ("d", "scalar X")], "path string, sdl string")
    assert [r["path"] for r in D.parse_documents(df).collect()] == ["d"]
    assert sorted(r["path"] for r in D.syntax_errors(df).collect()) == ["a", "b", "c"]
