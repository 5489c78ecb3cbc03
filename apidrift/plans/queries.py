"""Registered queries: one per operator of the coverage list.

Each takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
driver tables (or fixtures Spark derives from them). Column names match
the DuckDB oracle in ``plans.oracles``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apidrift.operators import diff, signatures
from apidrift.session import checkpoint, shared_path
from apidrift.sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def _i64(c):
    return F.col(c).cast("bigint").alias(c)


# --------------------------------------------------------------- catalogs, C, D

def _changes(spark, sf_dir):
    cat = fixtures.catalog(spark, sf_dir)
    old, new = diff.split_catalog(cat, "1.0", "2.0")
    return diff.api_changes(old, new)


@query("sig_params")
def q_sig_params(spark, sf_dir):
    cat = fixtures.catalog(spark, sf_dir)
    j = cat.withColumn("params", signatures.params_of(F.col("signature")))
    return j.select("lib", "version", "kind", "api_path",
                    F.size("params").cast("bigint").alias("n_params"),
                    signatures.params_text(F.col("params")).alias("params_text")
                    ).withColumn("n_params", F.when(F.col("params_text").isNotNull(),
                                                    F.col("n_params")))


@query("sig_parse_errors")
def q_sig_parse_errors(spark, sf_dir):
    cat = fixtures.catalog(spark, sf_dir)
    return signatures.parse_error_counts(
        cat.withColumn("params", signatures.params_of(F.col("signature"))))


@query("sig_compare")
def q_sig_compare(spark, sf_dir):
    cat = fixtures.catalog(spark, sf_dir)
    old, new = diff.split_catalog(cat, "1.0", "2.0")
    pairs = old.select(*diff.KEYS, F.col("signature").alias("old_signature")).join(
        new.select(*diff.KEYS, F.col("signature").alias("new_signature")), diff.KEYS)
    pairs = pairs.withColumn("old_params", signatures.params_of(F.col("old_signature"))) \
        .withColumn("new_params", signatures.params_of(F.col("new_signature")))
    return pairs.select(*diff.KEYS, signatures.compare_code(
        F.col("old_params"), F.col("new_params")).cast("bigint").alias("code"))


@query("api_changes")
def q_api_changes(spark, sf_dir):
    return _changes(spark, sf_dir).select(*diff.KEYS, "change")


@query("api_deleted")
def q_api_deleted(spark, sf_dir):
    return diff.deleted(_changes(spark, sf_dir))


@query("api_added")
def q_api_added(spark, sf_dir):
    return diff.added(_changes(spark, sf_dir))


@query("api_modified_a")
def q_api_modified_a(spark, sf_dir):
    return diff.modified(_changes(spark, sf_dir), "A").select(
        *diff.KEYS, "old_signature", "new_signature")


@query("api_modified_b")
def q_api_modified_b(spark, sf_dir):
    return diff.modified(_changes(spark, sf_dir), "B").select(
        *diff.KEYS, "old_signature", "new_signature")


@query("api_change_counts")
def q_api_change_counts(spark, sf_dir):
    c = diff.change_counts(_changes(spark, sf_dir))
    return c.select("lib", "kind", "change", _i64("n_apis"), "category")


@query("changed_api_lookup")
def q_changed_api_lookup(spark, sf_dir):
    return diff.changed_api_lookup(_changes(spark, sf_dir))


# ------------------------------------------------------- function call sites

from apidrift.operators import callsites, retrieve  # noqa: E402
from apidrift.plans import chain  # noqa: E402
from apidrift.operators.answers import AnswerStore, missing_entries  # noqa: E402
from apidrift.operators.index import CorpusIndex  # noqa: E402
from apidrift.sources.versions import VersionedTable, session_table  # noqa: E402

META = ("repository", "url", "last_updated", "stars")


def _inputs_key(spark, sf_dir):
    """Tells the input's files from others at the same path."""
    return chain.key_of(spark, *[f"{sf_dir}/{t}.parquet" for t in ("part", "lineitem", "orders", "customer")])


# Source files compress well and take long to parse: a scan that goes by size alone has too few tasks.
ROWS_PER_FILE = 5000


def _stored(spark, sf_dir, name, make):
    """A corpus as a table in the shared folder, as a corpus is in life.

    It is written once for a session and input; the scan splits it by size,
    so the parse starts where the files are read, without a shuffle. When the
    files at the path have changed it is written anew, and the old one goes.
    """
    table = session_table(spark, "corpora", name, sf_dir)
    key, m = _inputs_key(spark, sf_dir), table.manifest()
    if m is None or m.note["key"] != key:
        table.replace(make(), {"key": key}, keep=1, rows_per_file=ROWS_PER_FILE)
    return table.read()


def _corpus(spark, sf_dir):
    return _stored(spark, sf_dir, "functions",
                   lambda: retrieve.enrich(fixtures.corpus(spark, sf_dir)))


def _index(spark, sf_dir, name, corpus):
    """The identifier index of a corpus, made once for a session and input."""
    ix = CorpusIndex(spark, session_table(spark, "index", name, sf_dir, _inputs_key(spark, sf_dir)).path)
    if ix.table.manifest() is None:
        ix.add(corpus(spark, sf_dir))
    return ix


def _fn_records(spark, sf_dir, want=("fcall", "alias", "error"), fields=callsites.REC_FIELDS, keep=META):
    return callsites.parse_pass(_corpus(spark, sf_dir), libs=fixtures.LIBS,
                                want=want, keep=keep, fields=fields)


def _fn_sites(spark, sf_dir):
    return callsites.function_sites(_fn_records(spark, sf_dir, ("fcall",), callsites.CALL_FIELDS))


@query("import_aliases")
def q_import_aliases(spark, sf_dir):
    r = _fn_records(spark, sf_dir, ("alias",)).where("rec = 'alias'")
    return r.select("file_id", "lib", F.col("name").alias("alias"),
                    F.col("target").alias("full_name"))


@query("import_text")
def q_import_text(spark, sf_dir):
    c = fixtures.corpus(spark, sf_dir)
    return c.select("file_id", callsites.import_text(F.col("content")).alias("import_text"))


@query("function_calls")
def q_function_calls(spark, sf_dir):
    r = callsites.function_call_rows(_fn_records(spark, sf_dir, ("fcall",)))
    return r.select("file_id", "lib", "scope", "api_path",
                    (F.col("how") == "first").alias("is_first"),
                    F.col("line").cast("bigint").alias("line"))


@query("function_calls_first")
def q_function_calls_first(spark, sf_dir):
    return callsites.t6(_fn_sites(spark, sf_dir))


@query("script_calls")
def q_script_calls(spark, sf_dir):
    return callsites.t6(_fn_sites(spark, sf_dir)).where("scope = 'main'").select(
        "file_id", "API_path", "import", "context", "target_seq", "suffix")


@query("split_call")
def q_split_call(spark, sf_dir):
    s = _fn_sites(spark, sf_dir).where("scope = 'def' AND split.ok")
    return s.select("file_id", "api_path", F.col("split.api_name").alias("api_name"),
                    F.col("split.target_seq").alias("target_seq"))


@query("call_rejects")
def q_call_rejects(spark, sf_dir):
    recs = callsites.with_reasons(_fn_records(spark, sf_dir, ("fcall", "error"), callsites.CALL_FIELDS, ()))
    sites = callsites.function_sites(recs)
    return callsites.rejects(recs, sites).select("reason", _i64("n"))


# ------------------------------------------------------------------ retrieval

SEARCH_BUDGET = 12


def _changed_functions(spark, sf_dir):
    ch = _changes(spark, sf_dir)
    return ch.where("kind = 'function' AND change IN ('modified_A', 'modified_B')").select(
        "api_path", "kind")


def _search(spark, sf_dir):
    """Queries, matches and corpus. The match table (api, query, file) is
    small and feeds several consumers (totals, top-m, joins), so it is
    checkpointed once: the full corpus scan behind it never runs twice."""
    qs = retrieve.queries(_changed_functions(spark, sf_dir))
    found = _index(spark, sf_dir, "functions", _corpus).search(qs)
    return qs, checkpoint(found), _corpus(spark, sf_dir)


@query("api_patterns")
def q_api_patterns(spark, sf_dir):
    a = _changed_functions(spark, sf_dir)
    return a.select("api_path", F.posexplode(retrieve.patterns(F.col("api_path"))).alias(
        "pattern_no", "pattern")).select("api_path", _i64("pattern_no"), "pattern")


@query("api_queries")
def q_api_queries(spark, sf_dir):
    qs = retrieve.queries(_changed_functions(spark, sf_dir))
    return qs.select("api_path", _i64("query_no"),
                     F.array_join("terms", " | ").alias("terms"), "leaf")


@query("search_matches")
def q_search_matches(spark, sf_dir):
    _, m, _ = _search(spark, sf_dir)
    return m.select("api_path", _i64("query_no"), "file_id")


@query("search_budget")
def q_search_budget(spark, sf_dir):
    qs, m, _ = _search(spark, sf_dir)
    return retrieve.query_totals(qs, m, SEARCH_BUDGET).select(
        "api_path", _i64("query_no"), _i64("n_hits"), "kept")


@query("search_counts")
def q_search_counts(spark, sf_dir):
    qs, m, _ = _search(spark, sf_dir)
    return retrieve.hit_counts(retrieve.query_totals(qs, m, SEARCH_BUDGET)).select(
        "api_path", _i64("n_hits"))


@query("search_top_m")
def q_search_top_m(spark, sf_dir):
    qs, m, corpus = _search(spark, sf_dir)
    t = retrieve.query_totals(qs, m, SEARCH_BUDGET)
    return retrieve.top_m(m, t).select(
        "api_path", _i64("rank"), "file_id", _i64("query_no"))


@query("search_methods")
def q_search_methods(spark, sf_dir):
    ch = _changes(spark, sf_dir).where(
        "kind = 'method' AND change IN ('modified_A', 'modified_B')").select("api_path", "kind")
    qs = retrieve.queries(ch)
    m = _index(spark, sf_dir, "methods", _mcorpus).search(qs)
    return m.select("api_path", _i64("query_no"), "file_id")


@query("enrich_files")
def q_enrich_files(spark, sf_dir):
    return _corpus(spark, sf_dir).select(
        "file_id", "repository", "url", "stars",
        F.coalesce(F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss"),
                   F.lit("Unknown")).alias("last_updated"))


@query("filter_files")
def q_filter_files(spark, sf_dir):
    return retrieve.filter_files(_corpus(spark, sf_dir), stars_limit=0,
                                 time_limit="1995-06-30 00:00:00").select("file_id")


@query("usage_test")
def q_usage_test(spark, sf_dir):
    qs = retrieve.queries(_changed_functions(spark, sf_dir))
    m = _index(spark, sf_dir, "functions", _corpus).search(qs, keep=("content",))
    # tested in the search stage while the content is at hand; only the
    # small (api, file, used) rows are deduplicated
    return retrieve.usage_test(m).select("api_path", "file_id", "used").distinct()


# ---------------------------------------------------- method call sites, blocks

def _mcorpus(spark, sf_dir):
    return _stored(spark, sf_dir, "methods",
                   lambda: retrieve.enrich(fixtures.mcorpus(spark, sf_dir)))


def _mtargets(spark, sf_dir):
    cat = fixtures.catalog(spark, sf_dir).where("version = '2.0'")
    return callsites.method_targets(cat)


def _mrecs(spark, sf_dir, *want):
    return callsites.parse_pass(_mcorpus(spark, sf_dir), want=want, keep=META)


def _classes(spark, sf_dir):
    return _mtargets(spark, sf_dir).select(F.col("class").alias("target")).distinct()


@query("typed_vars")
def q_typed_vars(spark, sf_dir):
    r = _mrecs(spark, sf_dir, "mark")
    r = r.join(_classes(spark, sf_dir), "target", "left_semi")
    return r.select("file_id", F.col("name").alias("var"), F.col("target").alias("class"),
                    "how")


@query("constructor_calls")
def q_constructor_calls(spark, sf_dir):
    r = _mrecs(spark, sf_dir, "ctor")
    r = r.join(_classes(spark, sf_dir), "target", "left_semi")
    return r.select("file_id", F.col("target").alias("class"), _i64("line"),
                    F.col("name").alias("var"))


@query("method_calls")
def q_method_calls(spark, sf_dir):
    m = callsites.method_calls(_target_recs(spark, sf_dir, "mcall"), _mtargets(spark, sf_dir))
    return m.select("file_id", "api_path", _i64("line"), "var")


@query("method_files")
def q_method_files(spark, sf_dir):
    m = callsites.method_calls(_target_recs(spark, sf_dir, "mcall"), _mtargets(spark, sf_dir))
    return m.groupBy("api_path", "file_id").agg(F.count(F.lit(1)).alias("n_calls")).select(
        "api_path", "file_id", _i64("n_calls"))


@query("code_blocks")
def q_code_blocks(spark, sf_dir):
    b = callsites.parse_pass(_mcorpus(spark, sf_dir), want=("block",)).where("rec = 'block'")
    return b.select("file_id", F.col("visit_no").cast("bigint").alias("block_no"),
                    F.col("btype").alias("block_type"),
                    F.col("line").cast("bigint").alias("start_line"),
                    F.col("end_line").cast("bigint").alias("end_line"), "code")


@query("call_block")
def q_call_block(spark, sf_dir):
    j = callsites.placed_lines(_target_recs(spark, sf_dir, "mline"), _mtargets(spark, sf_dir))
    return j.select("file_id", "api_path", _i64("line"), _i64("block_no"), "block_type")


@query("split_method_call")
def q_split_method_call(spark, sf_dir):
    c = callsites.cut_lines(_target_recs(spark, sf_dir, "mcut"), _mtargets(spark, sf_dir))
    return c.select("file_id", "api_path", _i64("line"), "context", "target_seq", "suffix")


def _target_recs(spark, sf_dir, *want):
    """Records of target methods; files that can't hold one are not parsed."""
    files = _index(spark, sf_dir, "methods", _mcorpus).files_of_targets(_mtargets(spark, sf_dir))
    return callsites.parse_targets(files, want=want, keep=META)


def _method_meta(spark, sf_dir):
    s = callsites.method_sites(_target_recs(spark, sf_dir, "msite"), _mtargets(spark, sf_dir))
    return s.select("file_id", "lib", F.col("api_path").alias("API_path"), "repository", "url",
                    F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("last_updated"),
                    "stars", "import", "context", "target_seq", "suffix")


@query("method_metadata")
def q_method_metadata(spark, sf_dir):
    return _method_meta(spark, sf_dir).drop("lib")


T10 = ["file_id", "API_path", "repository", "url", "last_updated", "stars", "import",
       "context", "target_seq", "suffix"]


def _metadata(spark, sf_dir, targets=None, wanted=None):
    """Sites of both corpora from one pass; of methods those of ``targets`` (all of the new catalog),
    of functions those that may be in ``wanted`` (all)."""
    methods = _index(spark, sf_dir, "methods", _mcorpus).files_of_targets(
        _mtargets(spark, sf_dir) if targets is None else targets)
    files = callsites.files_of_both(_corpus(spark, sf_dir), methods, fixtures.LIBS, META)
    return callsites.sites_of_both(callsites.parse_targets(
        files, keep=META, libs=fixtures.LIBS, fields=callsites.SITE_FIELDS, wanted=wanted)).select("lib", *T10, "kind")


@query("metadata")
def q_metadata(spark, sf_dir):
    return _metadata(spark, sf_dir).drop("lib")


# ---------------------------------------------------------------- marker logs

from apidrift.operators import logs  # noqa: E402


@query("marker_log")
def q_marker_log(spark, sf_dir):
    out = logs.marker_log(fixtures.log_lines(spark, sf_dir), fixtures.LOG_FILE_RE,
                          fixtures.LOG_RECORD_RE, fixtures.LOG_CALL_RE, block=512)
    return out.select("file_name", "api_name", _i64("record_no"), _i64("line_no"),
                      "call_text")


# ---------------------------------------------- conversion, filter, synthesis

from apidrift.operators import batches, convert, synth  # noqa: E402


@query("build_content")
def q_build_content(spark, sf_dir):
    return convert.build_content(fixtures.legacy(spark, sf_dir)).select("file_id", "content")


def _filtered(spark, sf_dir):
    """Sites of changed APIs; a file is parsed only if it can hold one of these."""
    changes = checkpoint(_changes(spark, sf_dir))  # read by the index, by the pass and by the filter
    changed = changes.where("change IN ('modified_A', 'modified_B')")
    wanted = callsites.ApiSet.of(changed.where("kind = 'function'").select("api_path"))
    return convert.filter_changed(_metadata(spark, sf_dir, callsites.method_targets(changed), wanted), changes)


@query("filter_changed")
def q_filter_changed(spark, sf_dir):
    return _filtered(spark, sf_dir).select("kind", "file_id", "API_path", "change",
                                           "category")


@query("chain_sites")
def q_chain_sites(spark, sf_dir):
    """P4 in part: the files found for the changed functions, one per (repository,
    url), are parsed, and of the calls found those count whose API the file
    was found for."""
    qs, m, corpus = _search(spark, sf_dir)
    top = retrieve.top_m(m, retrieve.query_totals(qs, m, SEARCH_BUDGET))
    top = checkpoint(retrieve.distinct_files(
        top.select(F.col("api_path").alias("API_path"), "file_id"), corpus))
    files = _index(spark, sf_dir, "functions", _corpus).files_with(
        lambda words: top.select("file_id").distinct())
    recs = callsites.parse_pass(files, libs=fixtures.LIBS, want=("fcall",), keep=META)
    sites = callsites.t6(callsites.function_sites(recs)).select("lib", *T10).withColumn(
        "kind", F.lit("function"))
    found = convert.filter_changed(sites, _changes(spark, sf_dir))
    return found.join(top, ["API_path", "file_id"], "left_semi").select(
        "kind", "file_id", "API_path", "change", "category")


def _chain(spark, sf_dir, steps=None):
    """The chain over the driver tables, under one root for a session and input."""
    root = session_table(spark, "chain", sf_dir).path
    inputs = chain.Inputs(
        key=_inputs_key(spark, sf_dir), catalog=fixtures.catalog(spark, sf_dir),
        corpora={"function": _corpus(spark, sf_dir), "method": _mcorpus(spark, sf_dir)},
        model=fixtures.completion, libs=fixtures.LIBS, old_version="1.0", new_version="2.0",
        budget=SEARCH_BUDGET, batch_rows=4000)
    return chain.run(spark, root, inputs, steps or chain.STEPS)


@query("chain_cct")
def q_chain_cct(spark, sf_dir):
    """Catalogs to CCT rows, functions and methods, through all steps."""
    return _chain(spark, sf_dir).read("benchmark", "cct")


@query("chain_ect")
def q_chain_ect(spark, sf_dir):
    return _chain(spark, sf_dir).read("benchmark", "ect")


@query("chain_steps")
def q_chain_steps(spark, sf_dir):
    """Rows of each step's outputs, and what a second run and one of two steps do."""
    _chain(spark, sf_dir)
    again, some = _chain(spark, sf_dir), _chain(spark, sf_dir, ("extract", "filter"))
    out = None
    for step in chain.STEPS:
        if again.states[step] == "skipped":
            rows = spark.range(1).select(F.lit("").alias("name"), F.lit(0).cast("bigint").alias("n_rows"))
        else:
            rows = None
            for name in chain.OUTPUTS[step]:
                n = again.read(step, name).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
                rows = n if rows is None else rows.unionByName(n)
        rows = rows.select(F.lit(step).alias("step"), "name", "n_rows", F.lit(again.states[step]).alias("second_run"),
                           F.lit(some.states[step]).alias("run_of_two"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _prompts(spark, sf_dir):
    return synth.render_prompt(_filtered(spark, sf_dir),
                               diff.changed_api_lookup(_changes(spark, sf_dir)))


@query("render_prompt")
def q_render_prompt(spark, sf_dir):
    return _prompts(spark, sf_dir).select("kind", "file_id", "API_path", "prompt")


def _kept_prompts(spark, sf_dir):
    return _stored(spark, sf_dir, "prompts", lambda: _prompts(spark, sf_dir))


def _completed(spark, sf_dir):
    """Prompts with their answers. The answers of a session are in one store:
    whichever query comes first asks for them, the others find them there."""
    prompts = _kept_prompts(spark, sf_dir)
    store = AnswerStore(spark, session_table(spark, "answers", sf_dir).path)
    store.ask(prompts, fixtures.completion)
    return store.answered(prompts)


@query("answer_runs")
def q_answer_runs(spark, sf_dir):
    """A run that ends after one of its batches, one that goes on, one that finds all
    answers: keys each was given, and what became of them."""
    prompts = _kept_prompts(spark, sf_dir)
    store = AnswerStore(spark, shared_path(spark, "answers"))
    first = store.ask(prompts, fixtures.completion, batch_rows=1000, most_batches=1)
    then = store.ask(prompts, fixtures.completion, batch_rows=1000)
    last = store.ask(prompts, fixtures.completion, batch_rows=1000)
    rows = [("first two", first.keys, first.asked + then.asked, then.left, then.found == first.asked),
            ("third", last.keys, last.asked, last.left, last.found == last.keys)]
    return spark.createDataFrame(rows, "run string, n_keys bigint, n_asked bigint, n_left bigint, found_rest boolean")


@query("synthesis_missing")
def q_synthesis_missing(spark, sf_dir):
    """Call sites of all APIs that no changed catalog entry stands for."""
    return missing_entries(_metadata(spark, sf_dir), diff.changed_api_lookup(_changes(spark, sf_dir))).select(
        "lib", "kind", _i64("n_apis"), _i64("n_sites"))


@query("replace_in_place")
def q_replace_in_place(spark, sf_dir):
    """A10: filtered call sites are stored, and a job that reads them writes the synthesised
    rows in their place; the version before is removed."""
    table = VersionedTable(spark, shared_path(spark, "metadata"))
    table.replace(_filtered(spark, sf_dir), {"step": "filter"})
    prompts = synth.render_prompt(table.read(), diff.changed_api_lookup(_changes(spark, sf_dir)))
    store = AnswerStore(spark, session_table(spark, "answers", sf_dir).path)
    store.ask(prompts, fixtures.completion)
    good, _ = synth.synthesize(store.answered(prompts))
    table.replace(good.select(*T11), {"step": "synthesize"}, keep=1)
    return table.read().withColumn("n_versions", F.lit(len(table.versions())).cast("bigint"))


@query("synthesis_status")
def q_synthesis_status(spark, sf_dir):
    return _completed(spark, sf_dir).select("kind", "file_id", "API_path",
                                            _i64("attempts"), "ok")


@query("parse_answer")
def q_parse_answer(spark, sf_dir):
    c = _completed(spark, sf_dir)
    up, old = synth.parse_answer(F.col("answer"))
    return c.select("kind", "file_id", "API_path", up.alias("updated_code"),
                    old.alias("outdated_code"))


T11 = ["kind", "file_id", "API_path", "repository", "url", "last_updated", "stars",
       "import", "context", "suffix", "updated_code", "outdated_code",
       "updated_signature", "outdated_signature"]


@query("synthesize")
def q_synthesize(spark, sf_dir):
    good, _ = synth.synthesize(_completed(spark, sf_dir))
    return good.select(*T11)


@query("synthesis_rejects")
def q_synthesis_rejects(spark, sf_dir):
    """Rows whose answers never parsed, with the number of attempts."""
    _, bad = synth.synthesize(_completed(spark, sf_dir))
    return bad.select("kind", "file_id", "API_path", _i64("attempts"))


@query("bench_cct")
def q_bench_cct(spark, sf_dir):
    good, _ = synth.synthesize(_completed(spark, sf_dir))
    return synth.bench_rows(good, "cct")


@query("bench_ect")
def q_bench_ect(spark, sf_dir):
    good, _ = synth.synthesize(_completed(spark, sf_dir))
    return synth.bench_rows(good, "ect")


# ------------------------------------------------------------- prompt batches

def _samples(spark, sf_dir):
    fields = ("rec", "name", "scope", "how", "rel_start", "rel_end", "imports", "code")
    s = callsites.function_call_rows(_fn_records(spark, sf_dir, ("fcall",), fields, ())).where(
        "how = 'first' AND scope = 'def'")
    return s.select("file_id", F.col("api_path").alias("API_path"),
                    F.col("rel_start").alias("start_line_no"),
                    F.col("rel_end").alias("end_line_no"),
                    F.col("imports").alias("import"), "code")


@query("prompt_rows")
def q_prompt_rows(spark, sf_dir):
    return batches.prompt_rows(_samples(spark, sf_dir))


@query("truncate_left")
def q_truncate_left(spark, sf_dir):
    p = batches.prompt_rows(_samples(spark, sf_dir))
    tok = batches.whitespace_tokens(F.col("prompt"))
    return p.select("file_id", "API_path", F.size(tok).cast("bigint").alias("n_tokens"),
                    F.array_join(batches.truncate_left(tok, 16), " ").alias("tail"))


@query("assign_batches")
def q_assign_batches(spark, sf_dir):
    p = batches.prompt_rows(_samples(spark, sf_dir))
    b = batches.assign_batches(p, ["file_id", "API_path"], 64)
    # the rows carry their prompts through the numbering
    return b.where("prompt is not null").select(
        "file_id", "API_path", _i64("position"), _i64("batch_id"))


@query("read_batch")
def q_read_batch(spark, sf_dir):
    """Three batches out of the middle, read by number from the files that hold them."""
    files = batches.BatchFiles(spark, shared_path(spark, "batch_files"))
    files.write(batches.prompt_rows(_samples(spark, sf_dir)), ["file_id", "API_path"], 64, partitions=16)
    held = files.read(5, 7)
    few = all(len(files.files(k, k)) <= 2 for k in (5, 6, 7))
    return held.select("file_id", "API_path", _i64("position"), _i64("batch_id"), F.lit(few).alias("few_files"))


# ------------------------------------------------------- results by class, rejects

@query("sites_by_class")
def q_sites_by_class(spark, sf_dir):
    """G1: filtered call sites in a folder per library, kind and class, read back from there."""
    path = shared_path(spark, "sites_by_class")
    jsonl.sink_by_class(_filtered(spark, sf_dir), path)
    back = spark.read.schema("file_id bigint, API_path string, target_seq string, lib string, kind string, "
                             "category string").json(path)
    return back.select("lib", "kind", "category", "file_id", "API_path", "target_seq")


@query("changes_by_class")
def q_changes_by_class(spark, sf_dir):
    """The catalog entries of each change class in a folder of its own, read back from there."""
    path = shared_path(spark, "changes_by_class")
    jsonl.sink_by_class(diff.by_class(_changes(spark, sf_dir)), path)
    return spark.read.schema("api_path string, signature string, doc string, lib string, kind string, "
                             "category string").json(path)


@query("reject_reasons")
def q_reject_reasons(spark, sf_dir):
    """what can go wrong with a file or a call, by reason, over files with such things in them."""
    recs = callsites.with_reasons(callsites.parse_pass(
        fixtures.flawed(spark, sf_dir), libs=fixtures.LIBS, want=("fcall", "error"), fields=callsites.CALL_FIELDS))
    return callsites.rejects(recs, callsites.function_sites(recs)).select("reason", _i64("n"))


@query("text_lines")
def q_text_lines(spark, sf_dir):
    """A5: log lines written as text and read back stripped."""
    path = shared_path(spark, "lines")
    jsonl.write_lines(fixtures.log_lines(spark, sf_dir), "line", path)
    return jsonl.read_lines(spark, path).groupBy("line").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query("convert_rows")
def q_convert_rows(spark, sf_dir):
    """V1: a caller's conversion over all rows of a folder per library, into the same layout."""
    raw, out = shared_path(spark, "raw"), shared_path(spark, "converted")
    jsonl.sink_by_api(callsites.t6(_fn_sites(spark, sf_dir)), raw, keys=("lib",), compression="gzip")
    rows = spark.read.schema("file_id bigint, scope string, API_path string, target_seq string, lib string").json(raw)
    called = convert.switch(rows, lambda d: d.withColumn("n_args", F.when(F.length("target_seq") > 2, F.size(
        F.split("target_seq", ","))).otherwise(0)).withColumn("scope", F.upper("scope")).drop("target_seq"))
    jsonl.sink_by_api(called, out, keys=("lib",), compression="gzip")
    back = spark.read.schema("file_id bigint, scope string, API_path string, n_args bigint, lib string").json(out)
    return back.select("lib", "API_path", "file_id", "scope", "n_args")


@query("catalog_preferred")
def q_catalog_preferred(spark, sf_dir):
    """Text signatures of a supplied catalog first, then the stub's, then the source's."""
    files, cat = _lib_catalog(spark, sf_dir)
    # read by the stubs' join and by the choice: parsed once
    fns = checkpoint(cat.where("kind = 'function'"))
    path = shared_path(spark, "supplied")
    jsonl.export_catalog(fixtures.supplied(spark, sf_dir), path)
    best = catalog_ops.prefer_sources(fns, catalog_ops.stub_signatures(files, fns), jsonl.read_catalog(spark, path))
    return best.select("lib", "version", "api_path", "signature")


# ------------------------------------------------------------ parse ledger

from apidrift.operators.ledger import ParseLedger  # noqa: E402


@query("ledger_calls")
def q_ledger_calls(spark, sf_dir):
    """function calls from records kept by content; files of equal content are parsed once."""
    ledger = ParseLedger(spark, session_table(spark, "ledger", sf_dir).path, fixtures.LIBS, ("fcall",))
    r = callsites.function_call_rows(ledger.records(_corpus(spark, sf_dir)))
    return r.select("file_id", "lib", "scope", "api_path", (F.col("how") == "first").alias("is_first"),
                    F.col("line").cast("bigint").alias("line"))


@query("ledger_runs")
def q_ledger_runs(spark, sf_dir):
    """what each run over a growing corpus parses: most files, all files, all and copies under other ids."""
    ledger = ParseLedger(spark, shared_path(spark, "ledger"), fixtures.LIBS, ("fcall", "alias"))
    files = _corpus(spark, sf_dir).select("file_id", "content")
    copies = files.where("file_id % 5 = 0").withColumn("file_id", F.col("file_id") + F.lit(10**12))
    runs = [ledger.update(x) for x in (files.where("file_id % 10 <> 3"), files, files.unionByName(copies))]
    return spark.createDataFrame([(i, r.files, r.contents, r.parsed) for i, r in enumerate(runs, 1)],
                                 "run bigint, n_files bigint, n_contents bigint, n_parsed bigint")


# ------------------------------------------------------------ sources, sinks

from apidrift.sources import jsonl  # noqa: E402

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _raw_snippets(spark, sf_dir):
    """T1 rows of the top-m files of each changed function (crawler output)."""
    qs, m, _ = _search(spark, sf_dir)
    top = retrieve.top_m(m, retrieve.query_totals(qs, m, SEARCH_BUDGET)).select("api_path", "file_id")
    # what was found goes to the files, whose content stays where it is
    files = _index(spark, sf_dir, "functions", _corpus).files_with(lambda words: top, F.collect_list("api_path").alias("apis"))
    return files.withColumn("api_path", F.explode("apis")).select(
        "api_path", "repository", "url",
        F.coalesce(F.date_format("last_updated", ISO), F.lit("Unknown")).alias("last_updated"),
        "stars", "content")


@query("scan_corpus")
def q_scan_corpus(spark, sf_dir):
    path = shared_path(spark, "snippets")
    jsonl.write_snippets(_raw_snippets(spark, sf_dir), path)
    df = jsonl.read_snippets(spark, path)
    return df.select("api_path", "url", "stars", "last_updated",
                     F.md5("content").alias("content_md5"))


@query("scan_tolerant")
def q_scan_tolerant(spark, sf_dir):
    c = fixtures.corpus(spark, sf_dir)
    good = c.select(F.to_json(F.struct("repository", "url", "stars", "content")).alias("v"),
                    "file_id")
    bad = c.where("file_id % 9 = 0").select(
        F.concat(F.lit('{"repository": "'), F.col("repository"), F.lit('", broken')).alias("v"),
        "file_id")
    blank = c.where("file_id % 7 = 0").select(F.lit("").alias("v"), "file_id")
    path = shared_path(spark, "tolerant")
    good.unionByName(bad).unionByName(blank).select("v").write.text(path)
    ok, rej = jsonl.read_tolerant(spark, path, "repository string, url string, "
                                  "stars bigint, content string")
    return ok.select(F.lit("good").alias("status")).unionByName(
        rej.select(F.lit("corrupt").alias("status"))).groupBy("status").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))


@query("roundtrip_jsonl")
def q_roundtrip_jsonl(spark, sf_dir):
    rows = callsites.t6(_fn_sites(spark, sf_dir))
    path = shared_path(spark, "t6")
    jsonl.write_jsonl(rows, path, compression="gzip")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return jsonl.read_jsonl(spark, path, schema, glob=None)


@query("sink_by_api")
def q_sink_by_api(spark, sf_dir):
    rows = callsites.t6(_fn_sites(spark, sf_dir))
    path = shared_path(spark, "by_api")
    jsonl.sink_by_api(rows, path, keys=("lib", "API_path"))
    back = jsonl.read_folders(spark, path, "file_id bigint, scope string, lib string, API_path string")
    return back.groupBy("lib", "API_path").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


@query("catalog_from_json")
def q_catalog_from_json(spark, sf_dir):
    path = shared_path(spark, "catalog")
    jsonl.export_catalog(fixtures.catalog(spark, sf_dir), path)
    return jsonl.read_catalog(spark, path)


@query("decode_content")
def q_decode_content(spark, sf_dir):
    c = fixtures.corpus(spark, sf_dir)
    raw = F.when(F.col("file_id") % 11 == 0,
                 F.concat(F.unhex(F.lit("FF")), F.encode("content", "UTF-8"))).otherwise(
        F.encode("content", "UTF-8"))
    wrapped = F.regexp_replace(F.base64(raw), "(.{60})", "$1\n")
    d = jsonl.decode_content(wrapped)
    return c.select("file_id", F.md5(d).alias("content_md5"),
                    F.length(d).cast("bigint").alias("n_chars"))


# ------------------------------------------------------- catalogs from sources

from apidrift.operators import catalog as catalog_ops  # noqa: E402


def _lib_catalog(spark, sf_dir):
    files = _stored(spark, sf_dir, "libraries", lambda: fixtures.lib_files(spark, sf_dir))
    return files, catalog_ops.catalog_from_sources(files)


@query("catalog_functions")
def q_catalog_functions(spark, sf_dir):
    _, cat = _lib_catalog(spark, sf_dir)
    return cat.where("kind = 'function'").select("lib", "version", "api_path",
                                                  "signature", "doc")


@query("catalog_methods")
def q_catalog_methods(spark, sf_dir):
    _, recs = _lib_catalog(spark, sf_dir)
    recs = checkpoint(recs)
    methods = catalog_ops.with_reexports(recs, catalog_ops.with_inherited(recs))
    return methods.select("lib", "version", "api_path", "signature", "doc")


@query("catalog_stub")
def q_catalog_stub(spark, sf_dir):
    files, cat = _lib_catalog(spark, sf_dir)
    # read by the stubs' join and by the choice: parsed once
    fns = checkpoint(cat.where("kind = 'function'"))
    best = catalog_ops.prefer_sources(fns, catalog_ops.stub_signatures(files, fns))
    return best.select("lib", "version", "api_path", "signature")
