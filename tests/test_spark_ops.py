"""DataFrame operators on small literal frames, each against a brute force."""

import re

import pandas as pd
from pyspark.sql import functions as F

from apidrift.functions.pyparse import split_sample


def test_search_equals_cross_join_brute_force(spark):
    from apidrift.operators import retrieve

    files = [
        (1, "import lib.nn as N\nN.act.relu(x)\n"),
        (2, "from lib.nn.act import relu\nrelu(x)\n"),
        (3, "y = lib.nn.act.relu(x)\n"),
        (4, "y = lib.nn.act.relu6(x)\nrelu_ = 1\n"),       # bounded: no match
        (5, "from lib.nn import act\nact.relu(3)\n"),
        (6, "import lib.nn.act as A\nA.relu(1)\nc.go()\n"),
    ]
    corpus = spark.createDataFrame(files, "file_id bigint, content string")
    apis = spark.createDataFrame([("lib.nn.act.relu", "function"), ("lib.C.go", "method")],
                                 "api_path string, kind string")
    qs = retrieve.queries(apis)
    got = sorted(tuple(r) for r in retrieve.search(corpus, qs).collect())

    def bounded(t, text):
        pat = (r"(?<!\w)" if re.match(r"\w", t) else "") + re.escape(t) + (
            r"(?!\w)" if re.search(r"\w$", t) else "")
        return re.search(pat, text) is not None

    want = sorted((q.api_path, q.query_no, fid) for q in qs.collect()
                  for fid, text in files if all(bounded(t, text) for t in q.terms))
    assert got == want
    assert (("lib.nn.act.relu", 1, 3)) in got and not any(f == 4 for _, _, f in got)


def test_budget_and_top_m(spark):
    from apidrift.operators import retrieve

    qs = spark.createDataFrame([("a", q) for q in range(1, 5)], "api_path string, query_no int")
    m = spark.createDataFrame([("a", 1, i) for i in range(5)] + [("a", 2, i) for i in range(10, 14)]
                              + [("a", 3, 20)] + [("a", 4, 30)],
                              "api_path string, query_no int, file_id bigint")
    t = {r.query_no: (r.n_hits, r.kept) for r in retrieve.query_totals(qs, m, 8).collect()}
    assert t == {1: (5, True), 2: (4, True), 3: (1, False), 4: (1, False)}
    top = retrieve.top_m(m, retrieve.query_totals(qs, m, 8), m=7)
    assert [r.file_id for r in top.orderBy("rank").collect()] == [0, 1, 2, 3, 4, 10, 11]


def test_forward_fill_equals_pandas(spark):
    from apidrift.operators.logs import forward_fill

    rows = [("a", i, (i * 7) % 5 if i % 3 == 0 else None) for i in range(200)] + [
        ("b", i, i if i % 11 == 0 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    got = {(r.k, r.o): r.f for r in forward_fill(df, ["k"], "o", "v", "f", block=16).collect()}
    pdf = pd.DataFrame(rows, columns=["k", "o", "v"]).sort_values(["k", "o"])
    pdf["f"] = pdf.groupby("k")["v"].ffill()
    want = {(k, o): (None if pd.isna(f) else int(f)) for k, o, f in
            pdf[["k", "o", "f"]].itertuples(index=False)}
    assert got == want


def test_marker_log_resets_record_per_file(spark):              # Q4
    from apidrift.operators.logs import marker_log

    lines = ["Processing file: a-b-run.jsonl", "  L 3: x.run(...)",     # no record yet
             "R 1", "  L 4: x.run(...)", "  L 4: y.run(...)",          # last wins
             "  L 5: x = C(...)",                                         # no .run(
             "Processing file: a-b-go.jsonl", "  L 6: z.go(...)",         # record reset
             "R 2", "  L 7: z.go(...)"]
    df = spark.createDataFrame([("log", i, t) for i, t in enumerate(lines)],
                               "log_id string, line_no bigint, line string")
    out = marker_log(df, r"^Processing file:\s+(.+\.jsonl)$", r"^R\s+(\d+)$",
                     r"^L\s+(\d+):\s+(.+)$", block=4)
    got = sorted((r.file_name, r.record_no, r.line_no, r.call_text) for r in out.collect())
    assert got == [("a-b-go.jsonl", 2, 7, "z.go(...)"), ("a-b-run.jsonl", 1, 4, "y.run(...)")]


def test_assign_batches_equals_row_number(spark):
    from apidrift.operators.batches import assign_batches

    df = spark.createDataFrame([(i % 13, i) for i in range(500)], "g bigint, i bigint")
    got = {(r.g, r.i): (r.position, r.batch_id)
           for r in assign_batches(df, ["g", "i"], 32, partitions=7).collect()}
    order = sorted((i % 13, i) for i in range(500))
    assert got == {k: (n + 1, n // 32) for n, k in enumerate(order)}


def test_split_call_jvm_equals_python(spark):
    from apidrift.operators.callsites import split_call

    cases = [("def f(a):\n    b = a\n    r = L.m.f(b)\n    return r", 3, 3, "lib.m.f"),
             ("def f():\n    run(run(1))", 2, 2, "lib.run"),
             ("def f():\n    h(1)", 2, 2, "lib.m.f"),
             ("@d()\ndef f():\n    pass", 0, 0, "lib.d"),
             ("def f():\n    x = lib.a(\n        1)\n    return x", 2, 3, "lib.a")]
    df = spark.createDataFrame(cases, "code string, s int, e int, api string")
    got = [r.sp for r in df.select(split_call(F.col("code"), F.col("s"), F.col("e"),
                                              F.col("api")).alias("sp")).collect()]
    for (code, s, e, api), g in zip(cases, got):
        parts, reason = split_sample(code, s, e, api)
        assert g.reason == reason
        if parts:
            assert (g.api_name, g.context, g.target_seq, g.suffix) == parts


def test_result_independent_of_partition_count(spark):
    from apidrift.operators import callsites

    code = "import lib as L\ndef f(a):\n    return L.x(a)\n"
    rows = [(i, code.replace("x", f"x{i % 5}")) for i in range(40)]
    df = spark.createDataFrame(rows, "file_id bigint, content string")

    def run(n):
        r = callsites.parse_pass(df.repartition(n), libs=("lib",), want=("fcall",))
        return sorted((x.file_id, x.name, x.context) for x in r.collect())

    assert run(1) == run(16)


def test_build_content_and_filter(spark):
    from apidrift.operators.convert import build_content

    df = spark.createDataFrame([("from a import b,\nimport c\n", "    def f():\n        pass"),
                                ("import a\n", "  x = 1")], "import string, code string")
    got = [r.content for r in build_content(df).collect()]
    assert got[0] == "\nfrom a import b,wrong_package\nimport c\n" + "\n" * 4 + "def f():\n    pass"
    assert got[1] == "import a\n" + "\n" * 4 + "x = 1"


def test_tolerant_scan_and_catalog_roundtrip(spark, tmp_path):
    from apidrift.sources import jsonl

    p = tmp_path / "in"
    p.mkdir()
    (p / "x.jsonl").write_text('{"url": "u1", "stars": 3}\n\n{"url": broken\n{"url": "u2"}\n')
    good, bad = jsonl.read_tolerant(spark, str(p), "url string, stars bigint")
    assert sorted(r.url for r in good.collect()) == ["u1", "u2"]
    assert [r.line for r in bad.collect()] == ['{"url": broken']
    cat = spark.createDataFrame([("L", "1.0", "function", "L.f", "L.f(x)", None),
                                 ("L", "1.0", "function", "L.g", "L.g()", "doc")],
                                "lib string, version string, kind string, api_path string, "
                                "signature string, doc string")
    out = str(tmp_path / "cat")
    jsonl.export_catalog(cat, out)
    back = sorted(tuple(r) for r in jsonl.read_catalog(spark, out).collect())
    assert back == sorted(tuple(r) for r in cat.collect())


def test_usage_test_pairs_alias_with_its_own_suffix(spark):     # Q24
    from apidrift.operators.retrieve import usage_test

    df = spark.createDataFrame([
        ("a.b.c", "import a.b as Z\nZ.c(1)\n"),
        ("a.b.c", "import a as Q\nQ.b.c()\n"),
        ("a.b.c", "from a.b import c\nc()\n"),
        ("a.b.c", "from a.b import c\n"),
        ("a.b.c", "import a.b as Z\nZ.d(1)\n"),
        ("a.b.c", "x = a.b.c\n"),
    ], "api_path string, content string")
    assert [r.used for r in usage_test(df).collect()] == [True, True, True, True, False, True]


def test_inherited_methods_match_inspect(spark):
    """Brute force: build the classes in this test and ask inspect."""
    import inspect

    from apidrift.operators.catalog import catalog_from_sources, with_inherited

    src = ("class A:\n    def f(self, x):\n        'A.f doc'\n    def g(self):\n        'A.g doc'\n"
           "class B(A):\n    def f(self, x, y=1):\n        pass\n"
           "class M:\n    def g(self, z):\n        'M.g doc'\n    def h(self):\n        pass\n"
           "class C(B, M):\n    pass\n"
           "class P(A):\n    def g(self, p):\n        pass\n"
           "class Q(B, P):\n    def run(self):\n        pass\n")
    files = spark.createDataFrame([("L", "1", "L/k.py", src)],
                                  "lib string, version string, path string, content string")
    got = {r.api_path: (r.signature, r.doc)
           for r in with_inherited(catalog_from_sources(files)).collect()}
    import sys
    import types

    mod = types.ModuleType("apidrift_test_k")   # a real module: getdoc walks the MRO
    sys.modules[mod.__name__] = mod
    exec(compile(src, "k", "exec"), mod.__dict__)
    ns = mod.__dict__
    want = {}
    for cname in ("A", "B", "M", "C", "P", "Q"):
        for name, member in inspect.getmembers(ns[cname], inspect.isfunction):
            if name.startswith("_"):
                continue
            key = f"L.k.{cname}.{name}"
            want[key] = (key + str(inspect.signature(member)), inspect.getdoc(member))
    assert got == want
    assert got["L.k.Q.g"] == ("L.k.Q.g(self, p)", "A.g doc")          # diamond: P before A


def test_marker_log_default_patterns_from_a_text_file(spark, tmp_path):
    from apidrift.operators.logs import marker_log, read_log

    text = ("Processing file: lib-nn-Lin-forward.jsonl\n"
            "遍历到json 3\n"
            "  第 7 行: layer = lib.nn.Lin(...)\n"
            "  第 9 行: layer.forward(...)\n"
            "Processing file: lib-nn-Lin-reset.jsonl\n")
    p = tmp_path / "output.log"
    p.write_text(text, encoding="utf-8")
    out = marker_log(read_log(spark, str(p)))
    assert [(r.api_name, r.record_no, r.line_no, r.call_text) for r in out.collect()] == [
        ("forward", 3, 9, "layer.forward(...)")]


def test_assign_batches_shuffled_is_a_permutation(spark):
    from apidrift.operators.batches import assign_batches

    df = spark.createDataFrame([(i,) for i in range(300)], "k bigint")
    a = {r.k: r.position for r in assign_batches(df, ["k"], 50, shuffle_seed=7).collect()}
    b = {r.k: r.position for r in assign_batches(df, ["k"], 50, shuffle_seed=7,
                                                 partitions=3).collect()}
    assert sorted(a.values()) == list(range(1, 301)) and a == b
    assert a != {k: k + 1 for k in range(300)}


def test_top_m_hot_api_limits_before_the_shuffle(spark):
    from apidrift.operators import retrieve

    # one API holds most of the matches (a hot key)
    rows = [("hot", 1 + i % 3, i) for i in range(3000)] + [("cold", 1, i) for i in range(7)]
    m = spark.createDataFrame(rows, "api_path string, query_no int, file_id bigint")
    qs = spark.createDataFrame([(a, q) for a in ("hot", "cold") for q in (1, 2, 3)],
                               "api_path string, query_no int")
    top = retrieve.top_m(m, retrieve.query_totals(qs, m, 10_000), m=5)
    got = sorted((r.api_path, r.rank, r.file_id) for r in top.collect())
    assert got == sorted([("cold", k + 1, k) for k in range(5)]
                         + [("hot", k + 1, f) for k, f in enumerate([0, 3, 6, 9, 12])])
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_reexported_class_methods(spark):
    from apidrift.operators.catalog import catalog_from_sources, with_inherited, with_reexports

    files = spark.createDataFrame([
        ("L", "1", "L/core.py", "class K:\n    def run(self, a):\n        pass\n"
                                "def helper(x):\n    pass\n"),
        ("L", "1", "L/__init__.py", "from .core import K, helper\nfrom .core import K as _Hidden\n"
                                    "import os\n"),
    ], "lib string, version string, path string, content string")
    recs = catalog_from_sources(files)
    got = sorted(r.signature for r in with_reexports(recs, with_inherited(recs)).collect())
    assert got == ["L.K.run(self, a)", "L.core.K.run(self, a)"]
