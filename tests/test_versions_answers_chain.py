"""Versioned tables, the answer store, the identifier index and the chain of steps."""

import dataclasses
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from apidrift.operators import callsites, diff, retrieve, synth
from apidrift.operators.answers import AnswerStore, missing_entries
from apidrift.operators.index import CorpusIndex
from apidrift.plans import chain
from apidrift.session import shared_path
from apidrift.sources import fixtures
from apidrift.sources.versions import CommitConflict, VersionedTable

# workers can't import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def numbers(df):
    return sorted(r[0] for r in df.collect())


# ---------------------------------------------------------------- versions

def test_replace_reads_its_own_table(spark):
    t = VersionedTable(spark, shared_path(spark, "t"))
    assert t.manifest() is None
    t.replace(spark.range(4).toDF("a"), {"step": "one"})
    old = t.read()
    t.replace(t.read().select((F.col("a") * 10).alias("a")), {"step": "two"})
    assert numbers(t.read()) == [0, 10, 20, 30] and t.manifest().note == {"step": "two"}
    # a reader that began before keeps its rows; one version more, and they go
    assert numbers(old) == [0, 1, 2, 3]
    t.replace(spark.range(1).toDF("a"))
    assert t.versions() == [1, 2] and len(t.files.names(f"{t.path}/data")) == 2
    assert numbers(t.read(1)) == [0, 10, 20, 30]
    with pytest.raises(FileNotFoundError):
        t.read(0)


def test_a_crash_between_stage_and_commit_changes_nothing(spark):
    t = VersionedTable(spark, shared_path(spark, "t"))
    t.replace(spark.range(3).toDF("a"))
    lost = t.stage(spark.range(100).toDF("a"))
    assert numbers(t.read()) == [0, 1, 2] and t.versions() == [0]
    # it may still belong to a writer, until it is old
    assert t.vacuum() == [] and t.vacuum(older_than=0.0) == [lost]
    assert numbers(t.read()) == [0, 1, 2]


def test_a_failed_write_leaves_the_old_rows(spark):
    t = VersionedTable(spark, shared_path(spark, "t"))
    t.replace(spark.range(3).toDF("a"))
    with pytest.raises(Exception):
        t.replace(t.read().select(F.raise_error(F.lit("no")).alias("a")))
    assert numbers(t.read()) == [0, 1, 2] and t.versions() == [0]


def test_of_two_writers_one_is_told(spark):
    t = VersionedTable(spark, shared_path(spark, "t"))
    t.replace(spark.range(1).toDF("a"))
    a, b = t.stage(spark.range(2).toDF("a")), t.stage(spark.range(3).toDF("a"))
    assert t.commit((a,), "a bigint", 0) == 1
    with pytest.raises(CommitConflict):
        t.commit((b,), "a bigint", 0)
    assert numbers(t.read()) == [0, 1]
    assert not [n for n, _ in t.files.names(f"{t.path}/_versions") if n.endswith(".tmp")]


def test_append_and_compact(spark):
    t = VersionedTable(spark, shared_path(spark, "t"))
    for lo in (0, 10, 20):
        t.append(spark.range(lo, lo + 2).toDF("a"))
    assert numbers(t.read()) == [0, 1, 10, 11, 20, 21] and len(t.manifest().parts) == 3
    t.compact(keep=1)
    assert numbers(t.read()) == [0, 1, 10, 11, 20, 21] and len(t.manifest().parts) == 1
    assert len(t.files.names(f"{t.path}/data")) == 1


def test_partitioned_and_empty_tables(spark):
    t = VersionedTable(spark, shared_path(spark, "t"))
    t.replace(spark.range(6).select(F.col("id").alias("a"), (F.col("id") % 2).cast("int").alias("p")), partition_by=("p",))
    assert sorted(map(tuple, t.read().collect())) == [(i, i % 2) for i in range(6)]
    t.append(spark.range(6, 8).select(F.col("id").alias("a"), F.lit(5).cast("int").alias("p")))
    t.append(spark.range(8, 9).select(F.col("id").alias("a"), F.lit(5).cast("int").alias("p")))
    assert sorted(map(tuple, t.read().collect())) == [(i, i % 2 if i < 6 else 5) for i in range(9)]
    t.replace(t.read().where("a < 0"))
    assert t.read().count() == 0 and t.read().columns == ["a", "p"]


# ----------------------------------------------------------------- answers

PROMPT = "lib string, kind string, file_id bigint, API_path string, target_seq string, system string, prompt string"


def prompts(spark, n, prompt="ask {}", parts=3):
    rows = [("lib0", "function", i, f"lib0.f{i}", f"({i})", "sys", prompt.format(i)) for i in range(n)]
    return spark.createDataFrame(rows, PROMPT).repartition(parts)


def good_model(pdf):
    return [f"Latest answer:\n```python\nnew{t}\n```\nOutdated answer:\n```python\nold{t}\n```" for t in pdf["target_seq"]]


def no_model(pdf):
    raise AssertionError("a call was made")


def test_answers_are_paid_for_once(spark):
    store = AnswerStore(spark, shared_path(spark, "answers"))
    ask = prompts(spark, 30)
    twice = ask.unionByName(ask)
    assert dataclasses.astuple(store.ask(twice, good_model, batch_rows=7)) == (30, 0, 30, 0)
    assert dataclasses.astuple(store.ask(ask, no_model)) == (30, 30, 0, 0)
    got = store.answered(twice)
    assert got.count() == 60 and got.where("updated_code = concat('new', target_seq) AND ok AND attempts = 1").count() == 60
    # a prompt that changed is another question
    assert dataclasses.astuple(store.ask(prompts(spark, 30, "ask again {}"), good_model)) == (30, 0, 30, 0)
    assert store.answered(ask).count() == 30


def test_a_killed_run_goes_on_from_its_last_batch(spark):
    store = AnswerStore(spark, shared_path(spark, "answers"))
    ask = prompts(spark, 40)
    first = store.ask(ask, good_model, batch_rows=10, most_batches=2)
    assert first.asked + first.left == 40 and 0 < first.asked < 40

    def dies_at_30(pdf):
        if (pdf["file_id"] == 30).any():
            raise RuntimeError("lost")
        return good_model(pdf)

    try:
        store.ask(ask, dies_at_30, batch_rows=5)
    except Exception as e:
        assert "lost" in str(e)
    kept = store.answers().count()
    assert kept >= first.asked
    last = store.ask(ask, good_model, batch_rows=10)
    assert (last.found, last.asked, last.left) == (kept, 40 - kept, 0)
    assert numbers(store.answers().select("file_id")) == list(range(40))


def test_answers_that_never_parse(spark):
    store = AnswerStore(spark, shared_path(spark, "answers"))
    ask = prompts(spark, 6)
    store.ask(ask, lambda pdf: ["no"] * len(pdf), max_attempts=2)
    assert store.answers().where("NOT ok AND attempts = 2").count() == 6
    # they count as answered, unless they are to be asked again
    assert store.ask(ask, no_model).asked == 0
    assert store.ask(ask, good_model, again=True).asked == 6
    assert store.answers().where("ok").count() == 6


def test_missing_entries_are_counted(spark):
    sites = spark.createDataFrame([("l", "function", "l.a"), ("l", "function", "l.a"), ("l", "function", "l.b"),
                                   ("l", "method", "l.C.m"), ("k", "function", "l.b")], "lib string, kind string, API_path string")
    lookup = spark.createDataFrame([("l", "function", "l.b")], "lib string, kind string, api_name string")
    got = sorted(map(tuple, missing_entries(sites, lookup).collect()))
    assert got == [("k", "function", 1, 1), ("l", "function", 1, 2), ("l", "method", 1, 1)]


# ------------------------------------------------------------------- index

FILES = [
    (1, "import lib.mod as m\nm.fun(1)\n"),
    (2, "from lib.mod import fun\nfun(2)\n"),
    (3, "import lib\nlib.mod.fun(3)\nlib.mod.funny(3)\n"),
    (4, "import lib\nlib.mod.funny(4)\n"),
    (5, "from lib import Klass\nk = Klass()\nk.run(5)\n"),
    (6, "from lib import Klass as K\nk = K()\nk.stop(6)\n"),
    (7, "k.run(7)\n"),
    (8, ""),
    (9, "def broken(:\n    Klass run"),
    (10, "import lib\ndef f(k: lib.Klass, o: lib.Other):\n    o.run(1)\n    return k.run(k.run(10))\n"),
]


@pytest.fixture(scope="module")
def files(spark):
    rows = [(i, f"r{i % 2}", f"u{i}", None, i, t) for i, t in FILES]
    return spark.createDataFrame(rows, "file_id bigint, repository string, url string, last_updated timestamp, "
                                 "stars bigint, content string")


@pytest.fixture(scope="module")
def index(spark, files):
    ix = CorpusIndex(spark, shared_path(spark, "index"), buckets=4)
    ix.add(files.where("file_id <= 6"))
    ix.add(files.where("file_id > 6"))
    return ix


def test_index_search_equals_plain_search(spark, files, index):
    apis = spark.createDataFrame([("lib.mod.fun", "function"), ("lib.mod.funny", "function"), ("lib.Klass.run", "method"),
                                  ("lib.gone", "function")], "api_path string, kind string")
    qs = retrieve.queries(apis)
    want = sorted(map(tuple, retrieve.search(files, qs, keep=("content", "stars")).collect()))
    assert sorted(map(tuple, index.search(qs, keep=("content", "stars")).collect())) == want and want
    again = CorpusIndex(spark, index.table.path)
    assert sorted(map(tuple, again.search(qs, keep=("content", "stars")).collect())) == want


def test_an_index_is_opened_by_another_session(spark, index):
    other = spark.newSession()
    for part in index.table.manifest().parts:
        for kind in ("words", "files"):
            spark.sql(f"DROP TABLE apidrift_{kind}_{part}")
    ix = CorpusIndex(other, index.table.path)
    assert ix.files().count() == len(FILES)
    index._open.clear()


def test_search_moves_no_content(spark, index):
    qs = retrieve.queries(spark.createDataFrame([("lib.mod.fun", "function")], "api_path string, kind string")).persist()
    plan = index.search(qs)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert moved and "Bucketed: true" in plan
    tree = index.search(qs)._jdf.queryExecution().optimizedPlan().toString()
    assert "content" in tree
    # below every exchange only ids, words and queries are read
    depth = None
    for line in plan.splitlines():
        here = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and here <= depth:
            depth = None
        if "Exchange" in line:
            depth = here if depth is None else depth
        elif depth is not None:
            assert "content" not in line


def test_only_files_that_can_hold_a_target_are_parsed(spark, files, index):
    targets = spark.createDataFrame([("lib", "lib.Klass.run", "run", "lib.Klass")],
                                    "lib string, api_path string, method string, class string")
    got = index.files_of_targets(targets)
    assert numbers(got.select("file_id")) == [5, 9, 10]
    new = callsites.parse_targets(got, ("mcall", "msite", "error"))
    old = callsites.parse_pass(files, want=("mcall", "msite"))
    assert {r["target"] for r in new.collect() if r["rec"] == "mcall"} == {"lib.Klass"}
    for rec, keys in (("mcall", ["file_id", "line", "name"]), ("msite", ["file_id", "line", "context", "target_seq"])):
        want = sorted(map(tuple, callsites.of_targets(old.where(F.col("rec") == rec), targets).select(*keys).collect()))
        assert sorted(map(tuple, callsites.of_targets(new.where(F.col("rec") == rec), targets).select(*keys).collect())) == want
        assert want


def test_found_files_of_one_url_are_one_file(spark):
    found = spark.createDataFrame([("a", 2), ("b", 3), ("a", 3), ("c", 5), ("d", 6)], "API_path string, file_id bigint")
    facts = spark.createDataFrame([(1, "r", "u"), (2, "r", "u"), (3, "r", "u"), (4, "r", None), (5, "r", None), (6, "r", None)],
                                  "file_id bigint, repository string, url string")
    # file 1 has the same url, but was not found
    got = sorted(map(tuple, retrieve.distinct_files(found, facts).collect()))
    assert got == [("a", 2), ("b", 2), ("c", 5), ("d", 6)]


# ------------------------------------------------------------------- chain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    # a tenth of the corpora is enough to see what steps do
    return chain.Inputs(
        key="k1", catalog=fixtures.catalog(spark, SF), model=fixtures.completion, libs=fixtures.LIBS,
        corpora={"function": retrieve.enrich(fixtures.corpus(spark, SF)).where("file_id % 10 = 4"),
                 "method": retrieve.enrich(fixtures.mcorpus(spark, SF)).where("file_id % 10 = 4")},
        old_version="1.0", new_version="2.0", buckets=4)


def test_chain_restarts_where_it_stopped(spark, inputs):
    root = shared_path(spark, "chain")
    with pytest.raises(ValueError, match="reads the output of 'update'"):
        chain.run(spark, root, inputs, ("crawl",))
    with pytest.raises(ValueError, match="no such step"):
        chain.run(spark, root, inputs, ("fetch",))

    def down(pdf):
        raise RuntimeError("the model is down")

    with pytest.raises(Exception, match="the model is down"):
        chain.run(spark, root, dataclasses.replace(inputs, model=down))
    got = chain.run(spark, root, inputs)
    assert got.states == {"update": "kept", "crawl": "kept", "convert": "skipped", "extract": "kept", "filter": "kept",
                          "synthesize": "done", "benchmark": "done"}
    versions = {s: got.table(s, n).versions() for s in got.states if s != "convert" for n in chain.OUTPUTS[s]}
    again = chain.run(spark, root, dataclasses.replace(inputs, model=no_model))
    assert set(again.states.values()) == {"kept", "skipped"}
    assert versions == {s: got.table(s, n).versions() for s in versions for n in chain.OUTPUTS[s]}
    kinds = {r["kind"] for r in got.read("benchmark", "cct").select("kind").distinct().collect()}
    assert kinds == {"function", "method"}
    # settings of a step do it and what follows again; answers are still there
    more = chain.run(spark, root, dataclasses.replace(inputs, top_m=2, model=no_model))
    assert more.states["update"] == "kept" and more.states["crawl"] == more.states["benchmark"] == "done"
    assert more.read("benchmark", "cct").count() < got.read("benchmark", "cct").count() + 1


def test_chain_on_given_rows(spark, inputs):
    changed = diff.api_changes(*diff.split_catalog(inputs.catalog, "1.0", "2.0")).where(
        "change = 'modified_A' AND kind = 'function'").select("api_path").first()[0]
    lib, mod, leaf = changed.split(".")
    rows = [("function", changed, 1, "r", "u1", None, 3, f"from {lib}.{mod} import {leaf}\n", f"    def g(a):\n        return {leaf}(a)\n"),
            ("function", changed, 2, "r", "u2", None, 3, "import os\n", "    def g(a):\n        return a\n")]
    given = spark.createDataFrame(rows, "kind string, API_path string, file_id bigint, repository string, url string, "
                                  "last_updated timestamp, stars bigint, `import` string, code string")
    root = shared_path(spark, "chain")
    got = chain.run(spark, root, dataclasses.replace(inputs, given=given),
                    ("update", "convert", "extract", "filter", "synthesize", "benchmark"))
    assert got.states["crawl"] == "skipped" and got.states["convert"] == "done"
    (row,) = got.read("benchmark", "cct").collect()
    assert (row["API_path"], row["file_id"], row["answer"]) == (changed, 1, f"{leaf}_v2(a)")


def test_key_of_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    one = chain.key_of(spark, path)
    assert one == chain.key_of(spark, path)
    spark.range(5).write.mode("append").parquet(path)
    assert one != chain.key_of(spark, path)


def test_render_prompt_leaves_out_what_is_counted_missing(spark):
    sites = spark.createDataFrame([("l", "function", 1, "l.a", "c", "(t)", "s"), ("l", "function", 2, "l.b", "c", "(t)", "s")],
                                  "lib string, kind string, file_id bigint, API_path string, context string, target_seq string, suffix string")
    lookup = spark.createDataFrame([("l", "function", "l.b", "l.b(x)", "d", "l.b()", None)],
                                   "lib string, kind string, api_name string, updated_signature string, updated_doc string, "
                                   "outdated_signature string, outdated_doc string")
    assert synth.render_prompt(sites, lookup).count() == 1
    assert [tuple(r) for r in missing_entries(sites, lookup).collect()] == [("l", "function", 1, 1)]


def test_small_batches_are_asked_side_by_side(spark):
    store = AnswerStore(spark, shared_path(spark, "answers"))
    ask = prompts(spark, 40)
    assert dataclasses.astuple(store.ask(ask, good_model, batch_rows=1, most_batches=10)) == (40, 0, 10, 30)
    assert dataclasses.astuple(store.ask(ask, good_model, batch_rows=1)) == (40, 10, 30, 0)
    # a commit for some batches, not for each
    assert len(store.table.versions()) < 20 and len(store.table.manifest().parts) == 40
    assert numbers(store.answers().select("file_id")) == list(range(40))


def test_prompts_of_different_keys_do_not_move(spark, monkeypatch):
    """What is asked first goes to its files as it lies; only keys that several rows share are put together."""
    store, plans = AnswerStore(spark, shared_path(spark, "answers")), []
    made = AnswerStore._missing

    def kept(self, *args):
        df = made(self, *args)
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    monkeypatch.setattr(AnswerStore, "_missing", kept)
    ask = prompts(spark, 40)
    assert dataclasses.astuple(store.ask(ask, good_model, batch_rows=10)) == (40, 0, 40, 0)
    assert "Aggregate" not in plans[0] and "Join" not in plans[0]
    more = prompts(spark, 50).unionByName(prompts(spark, 50).where("file_id >= 45"))
    assert dataclasses.astuple(store.ask(more, good_model, batch_rows=10)) == (50, 40, 10, 0)
    assert numbers(store.answers().select("file_id")) == list(range(50))


def test_rows_without_a_key_of_their_own_are_asked_once(spark):
    store = AnswerStore(spark, shared_path(spark, "answers"))
    ask = prompts(spark, 5).withColumn("lib", F.when(F.col("file_id") > 2, F.col("lib")))
    assert dataclasses.astuple(store.ask(ask.unionByName(ask), good_model)) == (5, 0, 5, 0)


def test_a_failed_batch_leaves_the_job_beside_it(spark):
    store = AnswerStore(spark, shared_path(spark, "answers"))

    def dies_at_0(pdf):
        if (pdf["file_id"] == 0).any():
            raise RuntimeError("lost")
        return good_model(pdf)

    with pytest.raises(Exception, match="lost"):
        store.ask(prompts(spark, 40, parts=1).sortWithinPartitions("file_id"), dies_at_0, batch_rows=1)
    assert 0 < store.answers().count() < 40
    store.table.vacuum(1, older_than=0)
    assert store.ask(prompts(spark, 40), good_model, batch_rows=1).left == 0 and store.answers().count() == 40


def test_files_hold_so_many_rows(spark):
    t = VersionedTable(spark, shared_path(spark, "rows_per_file"))
    t.replace(spark.range(0, 100, 1, 2).toDF("a"), rows_per_file=10)
    assert t.read().select(F.input_file_name().alias("f")).distinct().count() == 10 and t.read().count() == 100
