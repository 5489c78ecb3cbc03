"""Parse ledger, one-pass term matching, batch files and outputs by class."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from apidrift.operators import batches, callsites, catalog, diff, retrieve
from apidrift.operators.ledger import ParseLedger
from apidrift.session import shared_path
from apidrift.sources import jsonl

CODE = "import lib as L\ndef f(a):\n    return L.m.g{}(a)\n"


def frame(spark, texts, start=1):
    return spark.createDataFrame(list(enumerate(texts, start)), "file_id bigint, content string").repartition(3)


# ------------------------------------------------------------- wanted APIs

def test_api_set_holds_its_paths_and_few_others(spark):
    paths = [f"lib.m{i % 7}.f{i}" for i in range(3000)] + [None, "", "x", "lib.é"]
    s = callsites.ApiSet.of(spark.createDataFrame([(p,) for p in paths], "p string"))
    assert all(p in s for p in paths if p is not None)
    assert sum(f"lib.m{i % 7}.g{i}" in s for i in range(3000)) < 30
    assert s.in_text("def a():\n    return q.f2999(1)") and not s.in_text("import lib.m1\nlib.m1.g5(1)\n")
    # a name that isn't ASCII may be written otherwise than in the catalog
    assert s.in_text("ﬁ(1)") and s.in_text(None)
    none = callsites.ApiSet.of(spark.createDataFrame([], "p string"))
    assert "lib.m.f" not in none and not none.in_text("lib.m.f()")


def test_pass_parses_only_files_with_a_wanted_api(spark):
    texts = ["import lib\ndef a():\n    lib.m.f(1)\n    lib.m.g(2)\n", "from lib.m import f as h\ndef a():\n    h(1)\n",
             "import lib\ndef a():\n    lib.m.g(2)\n", "import lib\nlib.m.f(\n", "import lib\nlib.n.f(3)\n"]
    files = frame(spark, texts).withColumn("targets", F.lit(None).cast(callsites.TARGETS))
    wanted = callsites.ApiSet.of(spark.createDataFrame([("lib.m.f",)], "p string"))
    cols = ["file_id", "rec", "name", "how", "context"]
    every = callsites.parse_targets(files, libs=("lib",)).where("name = 'lib.m.f' OR rec = 'error'").select(*cols)
    got = callsites.parse_targets(files, libs=("lib",), wanted=wanted).select(*cols)
    assert sorted(map(str, got.collect())) == sorted(map(str, every.collect()))
    assert sorted(r["file_id"] for r in got.collect()) == [1, 2, 4]


# ------------------------------------------------------------------ ledger

def test_one_added_file_parses_one_file(spark):
    ledger = ParseLedger(spark, shared_path(spark, "ledger"), ("lib",))
    files = frame(spark, [CODE.format(i) for i in range(12)])
    run = ledger.update(files)
    assert (run.files, run.contents, run.parsed) == (12, 12, 12)
    more = files.unionByName(frame(spark, [CODE.format("new")], 100))
    run = ledger.update(more)
    assert (run.files, run.contents, run.parsed) == (13, 13, 1)
    # copies and files without a record of theirs are known, too
    odd = frame(spark, [CODE.format(3), CODE.format(3), "x = 1\n", "def broken(:\n", "", None], 200)
    run = ledger.update(odd)
    assert (run.files, run.contents, run.parsed) == (5, 4, 3)
    assert ledger.update(odd).parsed == 0
    assert ledger.update(frame(spark, [])).parsed == 0


@pytest.mark.parametrize("want", [("fcall",), ("fcall", "alias", "error"), ("mcall", "block")])
def test_ledger_gives_the_records_of_a_parse(spark, want):
    texts = [CODE.format(i % 4) for i in range(9)] + ["def broken(:", None, "", "import lib\nv = lib.C()\nv.run(1)\nlib.g(2)\n"]
    files = frame(spark, texts).withColumn("stars", F.col("file_id") * 10)
    plain = callsites.parse_pass(files, libs=("lib",), want=want, keep=("stars",))
    ledger = ParseLedger(spark, shared_path(spark, "ledger"), ("lib",), want)
    for _ in range(2):
        got = ledger.records(files, keep=("stars",))
        assert got.columns == plain.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_ledgers_of_other_settings_are_apart(spark):
    path = shared_path(spark, "ledger")
    files = frame(spark, [CODE.format(1)])
    assert ParseLedger(spark, path, ("lib",)).update(files).parsed == 1
    assert ParseLedger(spark, path, ("lib", "other")).update(files).parsed == 1
    assert ParseLedger(spark, path, ("lib",), ("alias",)).update(files).parsed == 1
    assert ParseLedger(spark, path, ("lib",)).update(files).parsed == 0


# ---------------------------------------------------------------- matching

def bounded(term, text):
    left = r"(?<!\w)" if re.match(r"\w", term) else ""
    right = r"(?!\w)" if re.search(r"\w$", term) else ""
    return re.search(left + re.escape(term) + right, text) is not None


def test_marked_terms_match_like_bounded_patterns(spark):
    rng = random.Random(5)
    bits = ["a", "ab", "_a", "é", ".", "..", " ", "\n", "import", "as", "\x01", "\x02", "1", "-", "ba", "\\E", "$", "日本"]
    rows = []
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        term = "".join(rng.choices([b for b in bits if b not in ("\x01", "\x02")], k=rng.randint(1, 4)))
        rows.append((term, text))
    got = spark.createDataFrame(rows, "term string, text string").select(
        "term", "text", retrieve.edged(F.col("text")).contains(retrieve.edged(F.col("term"))).alias("hit")).collect()
    assert any(r["hit"] for r in got) and not all(r["hit"] for r in got)
    assert [r["hit"] for r in got] == [bounded(r["term"], r["text"]) for r in got]


def test_usage_in_all_forms(spark):
    api = "lib.mod.fun"
    texts = {
        "lib.mod.fun(1)": True, "xlib.mod.fun(1)": False, "lib.mod.funny(1)": False, "lib . mod": False,
        "from lib import mod\nmod.fun(1)": True, "from lib import mod\nfun(1)": False,
        "from lib.mod import fun\nfun(1)": True, "from lib.mod import funny\nfun(1)": False,
        "import lib as x\nx.mod.fun(1)": True, "import lib as x\ny.mod.fun(1)": False,
        "import lib.mod as m\nm.fun(1)": True, "import lib.mod  as  m\nm.fun": True, "import lib.mod.more as m\nm.fun(1)": False,
        "import other as o\nimport lib.mod as m\no.fun(1)": False, "import a as lib\nlib.mod.fun": True, "": False,
        "  import lib.mod as m\nm.fun(1)": False,
    }
    rows = spark.createDataFrame([(api, t) for t in texts], "api_path string, content string")
    assert {r["content"]: r["used"] for r in retrieve.usage_test(rows).collect()} == texts


def test_one_word_apis(spark):
    rows = spark.createDataFrame([("fun", "fun(1)"), ("fun", "funny(1)")], "api_path string, content string")
    assert [r["used"] for r in retrieve.usage_test(rows).collect()] == [True, False]


# ------------------------------------------------------------- batch files

@pytest.mark.parametrize("seed", [None, 1, 2])
def test_a_batch_is_read_from_one_or_two_files(spark, seed):
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), F.concat(F.lit("t"), "id").alias("prompt"))
    files = batches.BatchFiles(spark, shared_path(spark, "batches"))
    files.write(rows, ["k"], 40, shuffle_seed=seed, partitions=6)
    seen = []
    for b in range(13):
        assert 1 <= len(files.files(b, b)) <= 2
        got = files.read(b)
        assert {r["batch_id"] for r in got.select("batch_id").distinct().collect()} == {b}
        seen += [r["k"] for r in got.orderBy("position").collect()]
    assert sorted(seen) == list(range(500)) and (seen == list(range(500))) == (seed is None)
    assert len(files.files(0, 12)) > 2 and files.read(3, 5).count() == 120
    with pytest.raises(IndexError):
        files.read(13)


# ------------------------------------------------------------ outputs, ties

def test_classes_have_folders_and_are_replaced_alone(spark):
    cols = "lib string, version string, kind string, api_path string, signature string, doc string"
    old = spark.createDataFrame([("l", "1", "function", "l.a", "l.a(x)", "d"), ("l", "1", "function", "l.b", "l.b(x)", None),
                                 ("l", "1", "method", "l.C.m", "l.C.m(x)", None)], cols)
    new = spark.createDataFrame([("l", "2", "function", "l.a", "l.a(x, y)", "d"), ("l", "2", "method", "l.C.m", "l.C.m(x, k=1)", None),
                                 ("l", "2", "method", "l.C.n", "l.C.n()", None)], cols)
    path = shared_path(spark, "classes")
    jsonl.sink_by_class(diff.by_class(diff.api_changes(old, new)), path)

    def held():
        rows = spark.read.schema("api_path string, signature string, lib string, kind string, category string").json(path)
        return sorted((r["category"], r["kind"], r["signature"]) for r in rows.collect())

    want = [("Added_API", "method", "l.C.n()"), ("Deleted_API", "function", "l.b(x)"),
            ("Modified_API_A", "function", "l.a(x, y)"), ("Modified_API_B", "method", "l.C.m(x, k=1)"),
            ("Outdated_API_A", "function", "l.a(x)"), ("Outdated_API_B", "method", "l.C.m(x)")]
    assert held() == want
    jsonl.sink_by_class(diff.by_class(diff.api_changes(old.limit(0), new.where("api_path = 'l.C.n'"))), path)
    assert held() == want


def test_supplied_signature_comes_first_and_ties_are_ordered(spark):
    keys = "lib string, version string, api_path string, "
    fns = spark.createDataFrame([("l", "1", f"l.{x}", None if x == "d" else f"l.{x}(src)") for x in "abcd"], keys + "signature string")
    stubs = spark.createDataFrame([("l", "1", "l.a", "l.a(stub)"), ("l", "1", "l.b", "l.b(stub)")], keys + "stub_signature string")
    given = spark.createDataFrame([("l", "1", "l.a", "l.a(z)"), ("l", "1", "l.a", "l.a(text)"), ("l", "1", "l.a", None)],
                                  keys + "signature string")
    for parts in (1, 3):
        got = catalog.prefer_sources(fns, stubs, given.repartition(parts))
        assert sorted((r["api_path"], r["signature"]) for r in got.collect()) == [
            ("l.a", "l.a(text)"), ("l.b", "l.b(stub)"), ("l.c", "l.c(src)")]


def test_catalog_batches_are_bounded(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(catalog, "BATCH_CHARS", 2000)
    text = "".join(f"def f{i}(a, b={i}):\n    '''{'d' * 100}'''\n" for i in range(60))
    source = pa.RecordBatch.from_pydict({"lib": ["l"] * 3, "version": ["1"] * 3, "path": [f"l/m{i}.py" for i in range(3)],
                                         "content": [text, None, text]})
    out = list(catalog._records(iter([source])))
    assert sum(b.num_rows for b in out) == 120 and len(out) > 8 and max(b.num_rows for b in out) < 20


def test_a_replayed_batch_that_yields_less_leaves_nothing_old(spark):
    cols = "file_id bigint, lib string, API_path string"
    path = f"{shared_path(spark, 'stream')}/epoch=3"
    for rows in ([(1, "l", "l.a"), (2, "l", "l.b")], [(1, "l", "l.a")]):
        jsonl.sink_by_api(spark.createDataFrame(rows, cols), path, keys=("lib", "API_path"), mode="overwrite", only_keys=False)
    back = spark.read.schema(cols).json(path).collect()
    assert [(r["file_id"], r["API_path"]) for r in back] == [(1, "l.a")]


def test_a_corpus_is_written_anew_when_its_input_changes(spark, tmp_path):
    from apidrift.plans import queries

    for t in ("part", "lineitem", "orders", "customer"):
        spark.range(2).write.parquet(f"{tmp_path}/{t}.parquet")
    made = []

    def make():
        made.append(1)
        return spark.read.parquet(f"{tmp_path}/part.parquet")

    assert queries._stored(spark, str(tmp_path), "x", make).count() == 2
    assert queries._stored(spark, str(tmp_path), "x", make).count() == 2 and len(made) == 1
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/part.parquet")
    assert queries._stored(spark, str(tmp_path), "x", make).count() == 7 and len(made) == 2


def test_stream_output_is_json(spark, tmp_path):
    jsonl.write_jsonl(spark.range(2), f"{tmp_path}/j")
    lines = [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/j").collect()]
    assert sorted(x["id"] for x in lines) == [0, 1]


# ------------------------------------------------------------ many folders

def test_folders_are_read_in_a_few_tasks(spark, tmp_path):
    """Each folder had a task of its own."""
    rows = spark.range(300).selectExpr("id AS file_id", "concat('lib.f', id) AS API_path", "'lib' AS lib")
    jsonl.sink_by_api(rows, f"{tmp_path}/a", keys=("lib", "API_path"), compression="gzip")
    before = spark.conf.get(jsonl.LISTING)
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        back = jsonl.read_folders(spark, f"{tmp_path}/a", "file_id bigint, lib string, API_path string")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= jsonl.LISTING_TASKS * spark.sparkContext.defaultParallelism
    assert spark.conf.get(jsonl.LISTING) == before
    assert sorted(r["file_id"] for r in back.where("API_path = concat('lib.f', file_id)").collect()) == list(range(300))


def test_stored_rows_are_compressed(spark, tmp_path):
    rows = spark.range(50).selectExpr("id", "repeat('a', 1000) AS t")
    jsonl.write_jsonl(rows, f"{tmp_path}/z", compression="gzip")
    assert sum(f.stat().st_size for f in tmp_path.glob("z/*.json.gz")) < 10_000
    assert jsonl.read_jsonl(spark, f"{tmp_path}/z", "id bigint, t string", glob=None).where("length(t) = 1000").count() == 50


def test_first_parse_of_different_contents_moves_none(spark, monkeypatch):
    seen, parse = [], callsites.parse_pass

    def kept(files, **kw):
        seen.append(files._jdf.queryExecution().optimizedPlan().toString())
        return parse(files, **kw)

    monkeypatch.setattr(callsites, "parse_pass", kept)
    ledger = ParseLedger(spark, shared_path(spark, "ledger"), ("lib",))
    files = frame(spark, [CODE.format(i) for i in range(6)] + [None])
    assert ledger.update(files).parsed == 6 and "Join" not in seen[0]
    assert ledger.update(files.unionByName(frame(spark, [CODE.format(9), CODE.format(1)], 50))).parsed == 1
    assert ledger.records(files).count() == 6


def test_rejects_parse_once(spark):
    """Files that don't parse and calls that don't split were counted by a parse each."""
    texts = ["def broken(:\n", "import lib\n@lib.f(1)\ndef a():\n    return lib.g(2)\n", "x = 1\n", "import lib\n  y = 2\n"]
    parsed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            parsed.add(b.num_rows)
            yield b

    files = frame(spark, texts).mapInArrow(counted, "file_id bigint, content string")
    recs = callsites.with_reasons(callsites.parse_pass(files, libs=("lib",), want=("fcall", "error"), fields=callsites.CALL_FIELDS))
    got = callsites.rejects(recs, callsites.function_sites(recs))
    assert sorted(map(tuple, got.collect())) == [("IndentationError", 1), ("SyntaxError", 1), ("decorator", 1)]
    assert parsed.value == len(texts)
