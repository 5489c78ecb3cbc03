"""Signature parsing and comparison: hand cases, properties, JVM vs Python."""

import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from apidrift.functions.sigparse import normalise, parse_signature


def kinds(sig, compat=False):
    p = parse_signature(sig, compat=compat)
    return None if p is None else [(x["name"], x["kind"][:6], x["has_default"]) for x in p]


def brute_compare(p1, p2):
    """Written afresh from the rule list of SURVEY §2.3 (first hit wins)."""
    if p1 is None or p2 is None:
        return 0
    named = {"POSITIONAL_ONLY", "POSITIONAL_OR_KEYWORD", "KEYWORD_ONLY"}
    d1 = {}
    for p in p1:
        d1.setdefault(p["name"], p["has_default"])
    d2 = {}
    for p in p2:
        d2.setdefault(p["name"], p["has_default"])
    n1 = {p["name"] for p in p1 if p["kind"] in named}
    n2 = {p["name"] for p in p2 if p["kind"] in named}
    if any(d1[n] != d2[n] for n in n1 & n2):
        return 2
    if any(not d1[n] for n in n1 - n2) or any(not d2[n] for n in n2 - n1):
        return 2

    def sel(ps, *k):
        return [p for p in ps if p["kind"] in k]

    for k in ("POSITIONAL_ONLY", "POSITIONAL_OR_KEYWORD"):
        if len(sel(p1, k)) != len(sel(p2, k)):
            return 1
    pos = ("POSITIONAL_ONLY", "POSITIONAL_OR_KEYWORD")
    if [(p["name"], p["kind"]) for p in sel(p1, *pos)] != [
            (p["name"], p["kind"]) for p in sel(p2, *pos)]:
        return 1
    if {p["name"] for p in sel(p1, "KEYWORD_ONLY")} != {
            p["name"] for p in sel(p2, "KEYWORD_ONLY")}:
        return 1
    for k in ("VAR_POSITIONAL", "VAR_KEYWORD"):
        if len(sel(p1, k)) != len(sel(p2, k)):
            return 1
    return 0


def test_normalise_cuts_return_and_reprs():
    t = normalise("a.b.f(x, y=<object <inner> at 0x1>) -> int")
    assert t == "def a_b_f(x, y=None):\n    pass"
    assert normalise("no_bracket") is None


def test_parse_kinds():
    assert kinds("m.f(a, /, b, *args, c, d=1, **kw)") == [
        ("a", "POSITI", False), ("b", "POSITI", False), ("args", "VAR_PO", False),
        ("c", "KEYWOR", False), ("d", "KEYWOR", True), ("kw", "VAR_KE", False)]


def test_unparsable_forms():
    assert parse_signature("m.f($self, x)") is None          # Q15
    assert parse_signature("m.f") is None                    # Q14
    assert parse_signature("m.f(x, y=)") is None
    assert parse_signature(None) is None
    assert parse_signature("m.f(x\x00)") is None              # null byte


def test_positional_only_defaults_aligned_jointly():          # Q13
    fixed = parse_signature("m.f(a, /, b=2)")
    assert [p["has_default"] for p in fixed] == [False, True]
    old = parse_signature("m.f(a, /, b=2)", compat=True)
    assert [p["has_default"] for p in old] == [True, True]


SIGS = ["m.f(x, y=1, *, k=2)", "m.f(x, z, y=1, *, k=2)", "m.f(x, y=1)",
        "m.f(x, *, y=1, k=2)", "m.f(x=0, y=1, *, k=2)", "m.f(y, x=1, *, k=2)",
        "m.f(x, y=1, *args, k=2)", "m.f(x, y=1, *, k=2, **kw)", "m.f(a, /, x, y=1)",
        "m.f(x, /, y=1)", "m.f($self, x)", "m.f()", "m.f(*, k)", "m.f(*, k=1)",
        "m.f(x, y=1, *, j=2)", "m.f(x, y: int = 1, *, k=2) -> int"]


def test_compare_jvm_equals_python(spark):
    from pyspark.sql import functions as F

    from apidrift.operators.signatures import compare_code, parse_signatures, with_params

    pairs = list(itertools.product(SIGS, SIGS))
    df = spark.createDataFrame(pairs, "a string, b string")
    parsed = parse_signatures(df.select(F.col("a").alias("signature")).union(
        df.select("b")))
    j = with_params(with_params(df, "a", "pa", parsed), "b", "pb", parsed)
    got = {(r.a, r.b): r.code for r in
           j.select("a", "b", compare_code(F.col("pa"), F.col("pb")).alias("code")).collect()}
    for a, b in pairs:
        assert got[(a, b)] == brute_compare(parse_signature(a), parse_signature(b)), (a, b)


name = st.sampled_from(["a", "b", "c", "x", "y"])
param = st.tuples(name, st.booleans())


@st.composite
def signatures(draw):
    pos = draw(st.lists(param, max_size=4, unique_by=lambda p: p[0]))
    used = {p[0] for p in pos}
    kw = [p for p in draw(st.lists(param, max_size=3, unique_by=lambda p: p[0]))
          if p[0] not in used]
    # defaults must trail among positionals
    seen_default = False
    fixed = []
    for n, d in pos:
        seen_default = seen_default or d
        fixed.append((n, seen_default))
    parts = [f"{n}=1" if d else n for n, d in fixed]
    if draw(st.booleans()):
        parts.append("*args")
    elif kw:
        parts.append("*")
    parts += [f"{n}=1" if d else n for n, d in kw]
    if draw(st.booleans()):
        parts.append("**kw")
    return "m.f(" + ", ".join(parts) + ")"


@settings(max_examples=200, deadline=None)
@given(signatures(), signatures())
def test_compare_properties(s1, s2):
    p1, p2 = parse_signature(s1), parse_signature(s2)
    assert p1 is not None and p2 is not None
    assert brute_compare(p1, p1) == 0
    assert brute_compare(p1, p2) == brute_compare(p2, p1)


def test_diff_classes(spark):
    from apidrift.operators.diff import api_changes

    old = spark.createDataFrame([
        ("L", "function", "L.gone", "L.gone(x)", None),
        ("L", "function", "L.same", "L.same(x)", "d"),
        ("L", "function", "L.req", "L.req(x)", None),
        ("L", "function", "L.opt", "L.opt(x, *, k=1)", None),
        ("L", "function", "L.doc", "L.doc(x)", "old doc"),
    ], "lib string, kind string, api_path string, signature string, doc string")
    new = spark.createDataFrame([
        ("L", "function", "L.new", "L.new(x)", None),
        ("L", "function", "L.same", "L.same(x)", "d"),
        ("L", "function", "L.req", "L.req(x, y)", None),
        ("L", "function", "L.opt", "L.opt(x)", None),
        ("L", "function", "L.doc", "L.doc(x)", "new doc"),
    ], "lib string, kind string, api_path string, signature string, doc string")
    got = {r.api_path: r.change for r in api_changes(old, new).collect()}
    assert got == {"L.gone": "deleted", "L.new": "added", "L.same": "unchanged",
                   "L.req": "modified_A", "L.opt": "modified_B", "L.doc": "unchanged"}
    # swapping sides swaps added and deleted
    back = {r.api_path: r.change for r in api_changes(new, old).collect()}
    assert back["L.gone"] == "added" and back["L.new"] == "deleted"
