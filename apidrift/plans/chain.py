"""The whole chain, catalogs to benchmark, in steps with committed outputs.

``run(spark, root, inputs, steps)`` runs the steps that are named, in order:

    update      changes     catalogs of two versions -> change classes
    crawl       found, files    changed APIs -> files of the corpora that use them
    convert     found, files    the caller's own (import, code) rows instead of a crawl
    extract     sites       files -> call sites of the APIs they were found for
    filter      sites       sites of APIs changed in class A or B, labelled
    synthesize  metadata, rejects, missing    updated and outdated calls
    benchmark   cct, ect    question and answer rows

Each output is a versioned table under ``root/<step>``.  Its manifest holds a
key: a hash of the step, its settings and the keys of what it read.  A step whose
outputs have the key it would give them is kept as it is, so a second run does
no work, and a run that died goes on at the step it died in (``synthesize``: at
the batch).  A step that isn't named is left alone, and what follows reads what it
committed last, as a rerun on data that are there already.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apidrift.operators import callsites, convert, diff, retrieve, synth
from apidrift.operators.answers import BATCH_ROWS, AnswerStore, missing_entries
from apidrift.operators.index import CorpusIndex
from apidrift.sources.versions import Files, VersionedTable

STEPS = ("update", "crawl", "convert", "extract", "filter", "synthesize", "benchmark")
OUTPUTS = {"update": ("changes",), "crawl": ("found", "files"), "convert": ("found", "files"), "extract": ("sites",),
           "filter": ("sites",), "synthesize": ("metadata", "rejects", "missing"), "benchmark": ("cct", "ect")}
KINDS = ("function", "method")
META = ("repository", "url", "last_updated", "stars")
SITE = ["lib", "kind", "file_id", "API_path", "repository", "url", "last_updated", "stars", "import", "context",
        "target_seq", "suffix"]
T11 = ["kind", "file_id", "API_path", "repository", "url", "last_updated", "stars", "import", "context", "suffix",
       "updated_code", "outdated_code", "updated_signature", "outdated_signature"]
# Goes into every key: to be raised when a step's code gives other rows.
PASS = 1


@dataclass(frozen=True)
class Inputs:
    """What a chain is run on; ``key`` tells one input from another (``key_of`` for files)."""

    key: str
    catalog: DataFrame
    corpora: dict[str, DataFrame]
    model: Callable
    libs: tuple[str, ...]
    old_version: str
    new_version: str
    given: DataFrame | None = None
    budget: int = retrieve.BUDGET
    top_m: int = retrieve.TOP_M
    buckets: int | None = None
    batch_rows: int = BATCH_ROWS


def key_of(spark: SparkSession, *paths: str) -> str:
    """A key of input files: names, sizes and times of all files under the paths."""
    out = []
    for path in paths:
        files = Files(spark, path)
        todo = [files.at(path)]
        while todo:
            for s in files.fs.listStatus(todo.pop()):
                if s.isDirectory():
                    todo.append(s.getPath())
                else:
                    out.append([s.getPath().toString(), s.getLen(), s.getModificationTime()])
    return _hash(sorted(out))


def _hash(*parts) -> str:
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


@dataclass
class Chain:
    """A chain under ``root``, a folder that the driver and all executors share."""

    spark: SparkSession
    root: str
    inputs: Inputs
    source: str = "crawl"
    states: dict[str, str] = field(default_factory=dict)

    def table(self, step: str, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{step}/{name}")

    def read(self, step: str, name: str) -> DataFrame:
        return self.table(step, name).read()

    def index(self, kind: str) -> CorpusIndex:
        """The identifier index of a corpus, made once for an input."""
        ix = CorpusIndex(self.spark, f"{self.root}/index/{kind}/{self.inputs.key[:16]}", self.inputs.buckets)
        if ix.table.manifest() is None:
            ix.add(self.inputs.corpora[kind].select("file_id", *META, "content"))
        return ix

    # ------------------------------------------------------------- keys

    def upstream(self, step: str) -> tuple[str, ...]:
        return {"update": (), "crawl": ("update",), "convert": (), "extract": ("update", self.source),
                "filter": ("update", "extract"), "synthesize": ("update", "filter"), "benchmark": ("synthesize",)}[step]

    def committed(self, step: str) -> str | None:
        """The key of a step's outputs; None unless all are there and agree."""
        keys = set()
        for name in OUTPUTS[step]:
            m = self.table(step, name).manifest()
            keys.add(m.note.get("key") if m else None)
        return keys.pop() if len(keys) == 1 else None

    def key(self, step: str) -> str:
        before = []
        for up in self.upstream(step):
            k = self.committed(up)
            if k is None:
                raise ValueError(f"step {step!r} reads the output of {up!r}, which has none: run that first")
            before.append(k)
        i = self.inputs
        own = {"update": [i.key, i.old_version, i.new_version], "crawl": [i.key, i.budget, i.top_m],
               "convert": [i.key], "extract": [sorted(i.libs)]}.get(step, [])
        return _hash(PASS, step, own, before)

    # ------------------------------------------------------------- steps

    def update(self) -> dict[str, DataFrame]:
        old, new = diff.split_catalog(self.inputs.catalog, self.inputs.old_version, self.inputs.new_version)
        return {"changes": diff.api_changes(old, new)}

    def _changed(self) -> DataFrame:
        return self.read("update", "changes").where("change IN ('modified_A', 'modified_B')")

    def crawl(self) -> dict[str, DataFrame]:
        found, files = [], []
        for kind in KINDS:
            qs = retrieve.queries(self._changed().where(F.col("kind") == kind).select("api_path", "kind"))
            index = self.index(kind)
            matches = VersionedTable(self.spark, f"{self.root}/crawl/matches_{kind}")
            # totals and the first files of each API both read the matches
            matches.replace(index.search(qs), keep=1)
            m = matches.read()
            top = retrieve.top_m(m, retrieve.query_totals(qs, m, self.inputs.budget), self.inputs.top_m)
            pairs = top.select(F.col("api_path").alias("API_path"), "file_id")
            pairs = retrieve.distinct_files(pairs, index.files().select("file_id", "repository", "url"))
            table = VersionedTable(self.spark, f"{self.root}/crawl/found_{kind}")
            table.replace(pairs.select(F.lit(kind).alias("kind"), "API_path", "file_id"), keep=1)
            found.append(table.read())
            ids = table.read().select("file_id").distinct()
            files.append(index.files_with(lambda words, ids=ids: ids).select(
                F.lit(kind).alias("kind"), "file_id", *META, "content"))
        return {"found": found[0].unionByName(found[1]), "files": files[0].unionByName(files[1])}

    def convert(self) -> dict[str, DataFrame]:
        """``given``: kind, API_path, file_id, META, import and code of the caller's rows."""
        given = convert.build_content(self.inputs.given)
        return {"found": self.inputs.given.select("kind", "API_path", "file_id").distinct(),
                "files": given.select("kind", "file_id", *META, "content").dropDuplicates(["kind", "file_id"])}

    def extract(self) -> dict[str, DataFrame]:
        found, files = self.read(self.source, "found"), self.read(self.source, "files")
        changes = self.read("update", "changes")
        targets = callsites.method_targets(changes.where("change <> 'deleted'"))
        wanted = found.where("kind = 'method'").join(
            targets.withColumnRenamed("api_path", "API_path"), "API_path")
        wanted = wanted.groupBy("file_id").agg(F.collect_set(F.struct("class", "method", "lib")).alias("targets"))
        # only files that were found travel to their targets
        methods = files.where("kind = 'method'").join(wanted, "file_id")
        both = callsites.files_of_both(files.where("kind = 'function'"), methods, self.inputs.libs, META)
        sites = callsites.sites_of_both(callsites.parse_targets(
            both, keep=META, libs=self.inputs.libs, fields=callsites.SITE_FIELDS))
        return {"sites": sites.select(*SITE).join(found, ["kind", "API_path", "file_id"], "left_semi")}

    def filter(self) -> dict[str, DataFrame]:
        return {"sites": convert.filter_changed(self.read("extract", "sites"), self.read("update", "changes"))}

    def synthesize(self) -> dict[str, DataFrame]:
        rows = self.read("filter", "sites")
        lookup = diff.changed_api_lookup(self.read("update", "changes"))
        prompts = synth.render_prompt(rows, lookup)
        store = AnswerStore(self.spark, f"{self.root}/answers")
        store.ask(prompts, self.inputs.model, self.inputs.batch_rows)
        good, bad = synth.synthesize(store.answered(prompts))
        return {"metadata": good.select(*T11), "rejects": bad, "missing": missing_entries(rows, lookup)}

    def benchmark(self) -> dict[str, DataFrame]:
        rows = self.read("synthesize", "metadata")
        return {task: synth.bench_rows(rows, task) for task in ("cct", "ect")}

    # ------------------------------------------------------------- running

    def step(self, name: str) -> str:
        """Run a step unless its outputs are those it would give."""
        key = self.key(name)
        if self.committed(name) == key:
            return "kept"
        for out, df in getattr(self, name)().items():
            self.table(name, out).replace(df, {"key": key})
        return "done"


def run(spark: SparkSession, root: str, inputs: Inputs, steps: tuple[str, ...] = STEPS) -> Chain:
    """Run the steps that are named; ``states`` of the result tells what each did: done, kept or skipped.

    With ``crawl`` among the steps, ``convert`` is skipped; without both, what
    follows reads the output of whichever was committed, the crawl's first.
    """
    unknown = set(steps) - set(STEPS)
    if unknown:
        raise ValueError(f"no such step: {sorted(unknown)}; there are {STEPS}")
    chain = Chain(spark, root.rstrip("/"), inputs)
    if "crawl" not in steps and ("convert" in steps or (chain.committed("crawl") is None and chain.committed("convert"))):
        chain.source = "convert"
    for name in STEPS:
        on = name in steps and not (name == "convert" and chain.source == "crawl")
        chain.states[name] = chain.step(name) if on else "skipped"
    return chain
