"""Files and tables beyond the ordinary: nothing is capped, dropped or slow."""

import re
import time

from apidrift.functions.pyparse import import_text, scan_file, split_sample
from apidrift.functions.sigparse import normalise, parse_signature
from apidrift.operators import batches, callsites, catalog, logs

ONE_LINE = re.compile(
    r"^\s*(import\s+\S+(\s+as\s+\S+)?|\s*from\s+\S+\s+import\s+(\S+(\s+as\s+\S+)?)?"
    r"(\s*,\s*\S+(\s+as\s+\S+)?)*)\s*$")


def test_import_lines_match_the_pattern():
    lines = ["import a", "import a as b", "import a, b", "from a import b", "from a import b, c", "from a import b,c",
             "from a import b as c, d as e", "from a import b ,c", "from a import b , c as d", "from a import (b, c",
             "from a import b,", "from a import b, c  # noqa", "from a import b c", "from a import b as c d",
             "from .a import *", "from a import b as", "from a import , b", "import a as b c", "  from a import b as c,d",
             "from a import as", "from a import b, as c", "from a import b as c as d", "x = 1", "from a import b,, c",
             "from a import b,c as", "from a import ,", "from a import ,,", "from a import a ,"]
    for line in lines:
        m = ONE_LINE.match(line)
        assert import_text(line) == (m.group(1).strip() + "\n" if m else ""), line


def test_long_import_line_with_a_comment_is_fast():
    line = "from lib import " + ",".join(f"a{i}" for i in range(5000)) + "  # noqa"
    code = f"{line}\nimport lib\ndef f(x):\n    return lib.run(x)\n"
    began = time.time()
    assert import_text(code) == "import lib\n"
    assert [r["name"] for r in scan_file(code, libs=("lib",))] == ["lib.run"]
    assert time.time() - began < 1


def test_long_file_deep_tree_and_many_calls():
    code = "import lib\nx = lib.C()\n" + "# filler line\n" * 230_000 + "def f(a):\n    return lib.run(a)\n"
    assert len(code) > 3_000_000
    assert [r["name"] for r in scan_file(code, libs=("lib",)) if r["scope"] == "def"] == ["lib.run"]
    deep = "import lib\nc = lib.C()\ny = " + " + ".join(["1"] * 900) + "\ndef f(a):\n    c.go(1)\n    return lib.run(a)\n"
    kinds = [r["rec"] for r in scan_file(deep, libs=("lib",), want=("fcall", "mcall", "msite"))]
    assert "fcall" in kinds and "mcall" in kinds and "msite" in kinds and "error" not in kinds
    many = "import lib\ndef f(a):\n" + "    lib.run(a)\n" * 3000
    rows = scan_file(many, libs=("lib",))
    assert len(rows) == 3000
    assert sum(len(v) for r in rows for v in r.values() if isinstance(v, str)) < 10 * len(many)


def test_long_signature_is_parsed():
    text = "m.f(" + ", ".join(f"a{i}=<object <nested> at 0x{i}>" for i in range(9000)) + ") -> int"
    assert len(text) > 100_000 and len(parse_signature(text)) == 9000
    assert normalise("a.b(x, y=<o>) -> C") == "def a_b(x, y=None):\n    pass"
    assert normalise("no bracket") is None


def test_split_at_the_first_line():
    assert split_sample("lib.run(1)", 1, 1, "lib.run")[0] == ("lib.run", "\nlib.run", "(1)", "")


def test_output_batches_are_bounded(spark):
    files = spark.createDataFrame(
        [(i, f"import lib\ndef f{i}(a):\n" + "".join(f"    lib.m{k}(a)\n" for k in range(60))) for i in range(5)],
        "file_id bigint, content string").coalesce(1)
    small = callsites.parse_pass(files, libs=("lib",), batch_chars=5000)
    large = callsites.parse_pass(files, libs=("lib",))
    assert sorted(small.collect(), key=str) == sorted(large.collect(), key=str)
    assert small.count() == 300


def test_positions_with_payload_columns(spark):
    rows = spark.range(0, 200_000, 1, 8).selectExpr("(id * 7919) % 200000 as k", "sha2(cast(id as string), 256) as payload")
    got = batches.assign_batches(rows, ["k"], 100, partitions=8)
    r = got.selectExpr("count(distinct position) as n", "min(position) as lo", "max(position) as hi",
                       "sum(cast(position <> k + 1 as int)) as wrong", "count(payload) as m").first()
    assert tuple(r) == (200_000, 1, 200_000, 0, 200_000)


def _catalog(spark, files):
    rows = [("lib", "1", path, text) for path, text in files.items()]
    frame = spark.createDataFrame(rows, "lib string, version string, path string, content string")
    return catalog.catalog_from_sources(frame).cache()


def test_resolution_order_and_depth(spark):
    code = ["class A:\n    def f(self): 'A'\n", "class B:\n    def f(self): 'B'\n", "class C:\n    def f(self): 'C'\n",
            "class D: pass\n", "class E: pass\n", "class K1(A, B, C): pass\n", "class K2(D, B, E): pass\n",
            "class K3(D, A): pass\n", "class Z(K1, K2, K3): pass\n", "class L0:\n    def go(self): 'L0'\n"]
    code += [f"class L{i}(L{i - 1}): pass\n" for i in range(1, 13)]
    source = "".join(code)
    space: dict = {}
    exec(source, space)
    records = _catalog(spark, {"lib/m.py": source})
    got = {r["cls"]: r["mro"] for r in catalog.resolution_orders(records).collect()}
    for name, cls in space.items():
        if isinstance(cls, type):
            assert got[f"lib.m.{name}"] == [f"lib.m.{c.__name__}" for c in cls.__mro__[:-1]]
    methods = {r["api_path"]: r["doc"] for r in catalog.with_inherited(records).collect()}
    assert methods["lib.m.L12.go"] == "L0" and methods["lib.m.Z.f"] == space["Z"].f.__doc__


def test_conditional_members_chains_and_stars(spark):
    records = _catalog(spark, {
        "lib/__init__.py": "from .api import *\nfrom .api import Q as P\n",
        "lib/api.py": "from .core import Q, R as S\n",
        "lib/core.py": "try:\n    import x\n    def f(a): pass\nexcept ImportError:\n    def f(a, b): pass\n"
                       "if True:\n    class Q:\n        if True:\n            def run(self): pass\n"
                       "        else:\n            def run(self, old): pass\nclass R:\n    def go(self): pass\n",
        "lib/loop.py": "from .pool import X\n", "lib/pool.py": "from .loop import X\n"})
    found = {r["api_path"]: r["signature"] for r in records.where("kind in ('function', 'method')").collect()}
    assert found == {"lib.core.f": "lib.core.f(a)", "lib.core.Q.run": "lib.core.Q.run(self)",
                     "lib.core.R.go": "lib.core.R.go(self)"}
    methods = catalog.with_reexports(records, catalog.with_inherited(records))
    assert {r["api_path"] for r in methods.collect()} == {
        "lib.core.Q.run", "lib.core.R.go", "lib.api.Q.run", "lib.api.S.go", "lib.Q.run", "lib.S.go", "lib.P.run"}


def test_supplied_signatures_come_first(spark):
    keys = "lib string, version string, api_path string, signature string"
    functions = spark.createDataFrame([("l", "1", "l.a", "l.a(x)"), ("l", "1", "l.b", "l.b(x)")], keys)
    stubs = spark.createDataFrame([("l", "1", "l.a", "l.a(s)"), ("l", "1", "l.b", "l.b(s)")],
                                  keys.replace("signature", "stub_signature"))
    supplied = spark.createDataFrame([("l", "1", "l.a", "l.a(t)")], keys)
    got = {r["api_path"]: r["signature"] for r in catalog.prefer_sources(functions, stubs, supplied).collect()}
    assert got == {"l.a": "l.a(t)", "l.b": "l.b(s)"}


def test_marker_log_with_tabs(spark):
    lines = ["\tProcessing file: lib-m-run.jsonl\u3000", "\t遍历到json 1", " \t第 3 行: x.run(1)\r"]
    frame = spark.createDataFrame([("a", i, t) for i, t in enumerate(lines)], "log_id string, line_no bigint, line string")
    assert [(r["record_no"], r["line_no"], r["call_text"]) for r in logs.marker_log(frame).collect()] == [(1, 3, "x.run(1)")]


def test_large_library_file_is_parsed_in_pieces(monkeypatch):
    from apidrift.functions import pycatalog

    def records(text):
        return sorted(pycatalog.catalog_records("lib/m.py", text), key=str)

    source = ("from lib.base import Base as B\n" + "".join(
        f"class C{i}(B, Late):\n    \"\"\"\nclass Text:\n    pass\n    \"\"\"\n    def run(self, a={i}):\n        return 0\n"
        f"@deco\ndef f{i}(\na,\n# the next line stands in brackets\nb=(1,\n2)): pass\n" for i in range(300))
        + "class C7(B):\n    def other(self): pass\n    def run(self, z): pass\ndef f3(z): pass\nx = 1 + \\\n\\\n2\n"
        + "class Late: pass\nfrom lib.other import Base as B, Shown\nfrom lib.most import *\n")
    whole = records(source)
    assert len(whole) == 905 and ("class", "lib.m.C0", None, "class Text:\n    pass\n    ", "lib.other.Base,lib.m.Late") in whole
    assert ("method", "lib.m.C7.run", "lib.m.C7.run(self, z)", None, None) in whole
    assert ("function", "lib.m.f3", "lib.m.f3(z)", None, None) in whole
    sizes, parse = [], pycatalog._parse
    monkeypatch.setattr(pycatalog, "_parse", lambda text: sizes.append(len(text)) or parse(text))
    for size in (1, 50, 1000):
        monkeypatch.setattr(pycatalog, "PIECE_CHARS", size)
        sizes.clear()
        assert records(source) == whole
        assert max(sizes) < 1000 + 20 * size < len(source)
        assert records(source + "def broken(:\n") == []
        assert records("def broken(:\n" + source) == []


def test_stub_is_read_once_for_all_its_functions(spark):
    stub = ("def a(x, y=(1)) -> None: ...\ndef a(z): ...\ndef def b(q, def c(w\n) : ...\nclass K:\n    def d(self): ...\n"
            "undef e(1): ...\ndef f(no colon)\n")
    files = spark.createDataFrame(
        [("lib", "1", "lib/m.pyi", stub), ("lib", "1", "lib/m/__init__.pyi", "def a(other): ..."), ("lib", "1", "lib/n.pyi", "def a(no colon)"),
         ("lib", "1", "lib/o.pyi", None), ("lib", "1", "lib/m.py", "def a(src): ...")], "lib string, version string, path string, content string")
    functions = spark.createDataFrame([("lib", "1", f"lib.{m}.{n}") for m in "mno" for n in "abcdefg"],
                                      "lib string, version string, api_path string")
    got = catalog.stub_signatures(files, functions)
    assert sorted(r["stub_signature"] for r in got.collect()) == [
        "lib.m.a(other)", "lib.m.a(x, y=(1)", "lib.m.b(q, def c(w\n)", "lib.m.c(w\n)", "lib.m.d(self)", "lib.m.e(1)"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    join = plan[:plan.index("Generate")]
    assert "content" not in join and "head" not in join


def test_walks_skip_what_holds_no_call():
    import ast

    from apidrift.functions import pyparse

    code = '''import lib
@lib.a(lib.b(1))
async def f(x: lib.T[lib.c()] = lib.d(), *y, z=lib.e(), **k) -> lib.f():
    async with lib.g() as a, b:
        return [lib.h(i, *lib.i(), q=lib.j()) async for i in lib.k() if lib.l(i)]
def g(a, b=None):
    match lib.m(a):
        case lib.N(1, x=[p, *q], y={"k": r, **s}) | None if lib.o(r):
            del a[lib.p():1], b.c
        case _: global G
    try: x: int = lib.q() if a < lib.r() <= 2 else lambda v=lib.s(): lib.t(v)
    except* lib.U as e: raise lib.v() from lib.w()
    else: assert (yield lib.x()), f"{lib.y()!r:{lib.z()}}"
    while (n := lib.A()) and not -lib.B(): a += {lib.C(): lib.D(), **lib.E()}[lib.F()]
type W[T: lib.G()] = lib.H()
class K(lib.I, metaclass=lib.J()): k = await_ = {lib.L() for _ in lib.M()}
'''
    tree = ast.parse(code)
    walked, todo = [], [tree]
    while todo:
        node = todo.pop()
        walked.append(node)
        todo += pyparse._children(node)
    kinds = (ast.Call, ast.stmt, ast.excepthandler, ast.match_case, ast.arg)
    wanted = {n for n in ast.walk(tree) if isinstance(n, kinds) and not isinstance(n, (ast.Global, ast.Pass))}
    assert len(wanted) > 60 and wanted <= set(walked) and len(walked) == len(set(walked))
    assert len(walked) < 0.7 * sum(1 for _ in ast.walk(tree))
    # imports alone are asked for: no call is cut out
    rows = scan_file("import lib as L\ndef f():\n    L.run(1)\nL.run(2)\n", libs=("lib",), want=("alias",))
    assert [(r["name"], r["target"]) for r in rows] == [("L", "lib"), ("lib", "lib")]


def test_corpora_take_one_pass_over_the_items(spark, tmp_path):
    from apidrift.sources import fixtures

    part = [None, 5, 17, 34, 17, 40]
    rows = [(o, n, None if (o + n) % 7 == 0 else part[(o * n) % 6], o, 1.5, None) for o in [*range(1, 9), 97, 100] for n in range(1, 4)]
    rows.append((None, 1, 5, 1, 1.5, None))
    items = spark.createDataFrame(rows + rows[:4], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, "
                                  "l_extendedprice double, l_shipdate date")
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, 1, None), (2, 9, None), (3, 1, None), (3, 1, None)],
                          "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, -2.5)], "c_custkey long, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    for name in ("corpus", "mcorpus", "flawed", "legacy"):
        got = getattr(fixtures, name)(spark, str(tmp_path))
        want = fixtures.run_sql(spark, str(tmp_path), getattr(fixtures, f"{name}_sql")(fixtures.SPARK))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) != []
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and plan.count("collect_list") == 1


def test_rows_are_made_once_for_their_numbers(spark, tmp_path):
    from apidrift.operators.batches import assign_batches

    log = str(tmp_path / "log")

    def run(frames):
        with open(log, "a") as f:
            f.write("run\n")
        yield from frames

    rows = spark.range(0, 1000, 1, 3).mapInPandas(run, "id long")
    got = assign_batches(rows, ["id"], 64)
    assert sorted((r["id"], r["position"], r["batch_id"]) for r in got.collect()) == [(i, i + 1, i // 64) for i in range(1000)]
    assert open(log).read().count("run") == 3


def test_corpora_are_made_once_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    from apidrift.operators import retrieve
    from apidrift.sources import fixtures

    at = "timestamp_ntz '1995-01-01 00:00:00'"
    spark.range(60).selectExpr("id % 20 as l_orderkey", "id * 7 as l_partkey", "cast(id / 20 as int) as l_linenumber",
                               "1L as l_suppkey", "1.0D as l_extendedprice", f"{at} as l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(20).selectExpr("id as o_orderkey", "0L as o_custkey", f"{at} as o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(1).selectExpr("id as c_custkey", "5.5D as c_acctbal").write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(fixtures, "ROWS_PER_TASK", 4, raising=False)
    for make, sql, text in ((fixtures.corpus, fixtures.corpus_sql, "def g"), (fixtures.mcorpus, fixtures.mcorpus_sql, "(a, (a + 1) * 2)")):
        files = make(spark, str(tmp_path))
        expected = fixtures.run_sql(spark, str(tmp_path), sql(fixtures.SPARK)).select(*files.columns)
        assert sorted(files.collect(), key=str) == sorted(expected.collect(), key=str)
        assert files.rdd.getNumPartitions() == 15  # 60 rows, 4 a task
        plan = retrieve.enrich(files)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(text) == 1


def test_script_of_many_statements_is_cut_in_one_pass():
    import ast

    from apidrift.functions.pyparse import _script

    code = "import lib\n" + "x = ('é', \"a\",\r\n  1); y = 'ü'\n\x0cz = 2\r" * 3 + "w = 'é'"
    own = [n for n in ast.parse(code).body if not isinstance(n, ast.Import)]
    lines = [x for n in own for x in ast.get_source_segment(code, n).splitlines()]
    assert [x.strip() for x in _script(code, ast.parse(code)).splitlines()[1:]] == [x.strip() for x in lines]
    code = "".join(f"x{i} = ({i},\n  1)\n" for i in range(10000))
    tree = ast.parse(code)
    began = time.time()
    assert _script(code, tree).count("\n") == 20001
    assert time.time() - began < 2


def test_only_fields_asked_for_are_put_out(spark):
    files = spark.createDataFrame([(1, "import lib\ndef f(a):\n    return lib.run(a)\n")], "file_id bigint, content string")
    fields = ("rec", "name", "imports", "method")
    recs = callsites.parse_pass(files, libs=("lib",), fields=fields)
    assert recs.columns == ["file_id", *fields]
    assert [tuple(r) for r in recs.collect()] == [(1, "fcall", "lib.run", "import lib\n", None)]
    whole = callsites.parse_pass(files, libs=("lib",)).first().asDict()
    assert set(callsites.REC_FIELDS) < set(whole) and whole["code"].startswith("def f(a):")


def test_index_deals_queries_once_and_has_buckets_by_its_files(spark, monkeypatch):
    from pyspark.sql import functions as F

    from apidrift.operators import index, retrieve
    from apidrift.session import shared_path

    monkeypatch.setattr(index, "FILES_PER_BUCKET", 3, raising=False)
    monkeypatch.setattr(index, "BUCKETS", 2)
    files = spark.range(20).select(F.col("id").alias("file_id"), F.concat(
        F.lit("import lib\ny = lib.f"), (F.col("id") % 4).cast("string"), F.lit("(1)\n")).alias("content"))
    ix = index.CorpusIndex(spark, shared_path(spark, "index"))
    ix.add(files)
    assert list(ix.table.manifest().note["buckets"].values()) == [7]
    qs = retrieve.queries(spark.createDataFrame([("lib.f1", "function"), ("lib.f3", "function")], "api_path string, kind string"))
    found = ix.search(qs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(file_id") == 1
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, retrieve.search(files, qs).collect()))
    assert found.count() > 0
