"""Call sites of functions (F1-F11), methods (M1-M8) and blocks (K1-K6).

One Python parse per file (``parse_pass``), in the stage that scans the
files: it finds calls, places them in their blocks and cuts them, since it
has the file at hand. What follows are filters and equi-joins with the
target APIs, so no source text is shuffled before it is parsed.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apidrift.session import checkpoint

REC_SCHEMA = ("rec string, lib string, name string, target string, method string, "
              "scope string, how string, visit_no int, line int, end_line int, "
              "rel_start int, rel_end int, block_no int, code string, imports string, "
              "btype string, reason string, api_name string, context string, "
              "target_seq string, suffix string")

REC_FIELDS = [f.strip().split(" ")[0] for f in REC_SCHEMA.split(",")]

# An output batch is closed when its texts reach this size: Arrow string
# columns hold 2 GiB, and a batch should stay a small part of a task's memory.
BATCH_CHARS = 16 << 20

_INTS = ("visit_no", "line", "end_line", "rel_start", "rel_end", "block_no")


# Fields that a record of a kind can fill; columns of the others hold nulls only.
_SITE = ("lib", "name", "target", "method", "visit_no", "line", "block_no", "btype", "context", "target_seq", "suffix")
_FILLED = {
    "fcall": ("lib", "name", "scope", "how", "visit_no", "line", "end_line", "rel_start", "rel_end", "code", "imports",
              "reason", "api_name", "context", "target_seq", "suffix"),
    "alias": ("lib", "name", "target", "visit_no"), "mark": ("name", "target", "how", "visit_no"),
    "ctor": ("name", "target", "line", "visit_no"), "mcall": ("lib", "name", "target", "method", "line", "visit_no"),
    "mline": _SITE, "mcut": _SITE, "msite": (*_SITE, "imports"),
    "block": ("btype", "code", "line", "end_line", "visit_no")}
_TEXTS = ("code", "imports", "context", "target_seq", "suffix")

# What makes a call site (``sites_of_both``), and what ``t6`` and ``rejects`` read of function calls.
SITE_FIELDS = ("rec", "lib", "name", "target", "method", "how", "reason", "imports", "context", "target_seq", "suffix")
CALL_FIELDS = ("rec", "lib", "name", "scope", "how", "reason", "imports", "api_name", "context", "target_seq", "suffix")


def _rec_schema(fields) -> str:
    kinds = dict(f.strip().split(" ") for f in REC_SCHEMA.split(","))
    return ", ".join(f"{f} {kinds[f]}" for f in fields)


def _targets_of(column):
    """The targets of each file of a batch, as (class, method, lib) by lists; None where there are none."""
    values, ends = column.values, column.offsets.to_pylist()
    names = [f.name for f in values.type]
    cols = [values.field(k).to_pylist() if k in names else [None] * len(values) for k in ("class", "method", "lib")]
    return [list(zip(*[c[a:b] for c in cols])) if ok else None
            for a, b, ok in zip(ends, ends[1:], column.is_valid().to_pylist())]


# Bits of an ``ApiSet``: so many for each path, and 16 MB of them at most.
_BITS_EACH, _LEAST_BITS, _MOST_BITS = 64, 1 << 16, 1 << 27
_MIX, _WORD = 0x2545F491, re.compile(r"\w+")


class ApiSet:
    """API paths as bits of their hashes, to tell in the pass which calls can be of these.

    It may hold a path too many, never one too few, so a join with the paths
    themselves still has to follow.  Its size is bounded, however many paths there are.
    """

    def __init__(self, paths: bytes, leaves: bytes):
        self.paths, self.leaves = paths, leaves

    @classmethod
    def of(cls, paths: DataFrame) -> "ApiSet":
        """Of the one column of ``paths``."""
        p = paths.select(F.col(paths.columns[0]).alias("p")).where("p IS NOT NULL")
        n = min(_MOST_BITS, max(_LEAST_BITS, 1 << (_BITS_EACH * p.count()).bit_length()))
        names = p.select(F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("p")), F.struct(
            F.lit(1).alias("k"), F.substring_index("p", ".", -1).alias("p")))).alias("x")).select("x.k", F.crc32("x.p").alias("h"))
        bits = names.select("k", F.explode(F.array(F.expr(f"h & {n - 1}"), F.expr(f"shiftright(h * {_MIX}L, 20) & {n - 1}"))).alias("b"))
        # 4 KB for 32,768 bits
        rows = bits.groupBy("k", F.shiftright("b", 15).alias("at")).agg(F.expr("bitmap_construct_agg(b & 32767L)").alias("m")).collect()
        out = bytearray(n // 8), bytearray(n // 8)
        for r in rows:
            part = bytes(r["m"])[:n // 8]
            out[r["k"]][r["at"] * 4096:r["at"] * 4096 + len(part)] = part
        return cls(bytes(out[0]), bytes(out[1]))

    @staticmethod
    def _has(bits: bytes, name: str) -> bool:
        h, last = zlib.crc32(name.encode("utf-8", "surrogatepass")), len(bits) * 8 - 1
        a, b = h & last, (h * _MIX >> 20) & last
        return bool(bits[a >> 3] >> (a & 7) & 1 and bits[b >> 3] >> (b & 7) & 1)

    def __contains__(self, path: str) -> bool:
        return self._has(self.paths, path)

    def in_text(self, text: str | None) -> bool:
        """Whether a call of a path can be in a source file: the path's last name is in the call or in an import."""
        # other names may be written in several ways
        return text is None or not text.isascii() or any(self._has(self.leaves, w) for w in set(_WORD.findall(text)))


def _pass_fn(libs, want, classes, batch_chars, by_file=False, fields=REC_FIELDS, wanted=None):
    """``by_file``: the third column holds the targets of each file, null where its function calls
    (of ``wanted``, if given) are asked for."""
    libs, want, fields = tuple(libs), tuple(want), tuple(fields)
    kinds = {*want, "fcall"} if by_file else set(want)
    filled = {"rec", "reason"}.union(*(_FILLED.get(k, ()) for k in kinds))
    classes = None if classes is None else frozenset(classes)
    kept = 3 if by_file else 2

    def run(batches):
        import gc

        import pyarrow as pa

        from apidrift.functions.pyparse import quiet, scan_file

        # trees hold no cycles and go with their file: looking for cycles at each few of them finds none
        gc.set_threshold(100_000, 50, 100)

        def batch_of(b, rows, idx):
            take = pa.array(idx, type=pa.int64())
            cols = [b.column(0).take(take)]
            for f in fields:
                kind = pa.int32() if f in _INTS else pa.string()
                cols.append(pa.array([r[f] for r in rows], type=kind) if f in filled else pa.nulls(len(rows), kind))
            cols += [b.column(k).take(take) for k in range(kept, b.num_columns)]
            return pa.RecordBatch.from_arrays(cols, names=["file_id", *fields, *b.schema.names[kept:]])

        def records(text, targets):
            if not by_file:
                return scan_file(text.as_py(), libs=libs, want=want, classes=classes)
            if targets is None:
                code = text.as_py()
                if wanted is not None and not wanted.in_text(code):
                    return ()
                return scan_file(code, libs=libs, want=("fcall",), wanted=wanted)
            own: dict = {}
            for c, m, lib in targets:
                own.setdefault((c, m), []).append(lib)
            found = scan_file(text.as_py(), want=want, classes=frozenset(c for c, _ in own), targets=own)
            return [{**r, "lib": lib} for r in found for lib in sorted(own.get((r["target"], r["method"]), [None]), key=str)]

        with quiet():
            for b in batches:
                rows, idx, size = [], [], 0
                targets = _targets_of(b.column(2)) if by_file else [None] * b.num_rows
                for i, text in enumerate(b.column(1)):
                    for r in records(text, targets[i]):
                        rows.append(r)
                        idx.append(i)
                        size += 200
                        for f in _TEXTS:
                            if r[f]:
                                size += len(r[f])
                        if size >= batch_chars:
                            yield batch_of(b, rows, idx)
                            rows, idx, size = [], [], 0
                yield batch_of(b, rows, idx)
    return run


def parse_pass(files: DataFrame, libs=(), want=("fcall",), classes=None,
               keep=(), batch_chars: int = BATCH_CHARS, fields=REC_FIELDS) -> DataFrame:
    """Parse every file once on the executors; flat records out.

    ``files`` has ``file_id`` and ``content``; ``keep`` names columns
    copied onto every record (so no join back to the file table is
    needed); ``fields`` are those of a record that are put out. For function calls, files that never mention any library
    name are dropped in the JVM before any Python runs.
    """
    src = files.select("file_id", "content", *keep)
    if libs and set(want) <= {"fcall", "alias", "error"} and "error" not in want:
        cond = None
        for lib in libs:
            c = F.col("content").contains(lib)
            cond = c if cond is None else cond | c
        src = src.where(cond)
    keep_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}"
                            for f in src.schema.fields[2:])
    schema = f"file_id bigint, {_rec_schema(fields)}" + (f", {keep_schema}" if keep_schema else "")
    return src.mapInArrow(_pass_fn(libs, want, classes, batch_chars, fields=fields), schema)


def parse_targets(files: DataFrame, want=("msite",), keep=(), libs=(), batch_chars: int = BATCH_CHARS,
                  fields=REC_FIELDS, wanted: ApiSet | None = None) -> DataFrame:
    """``parse_pass`` for method targets that go with each file.

    ``files`` has file_id, content and ``targets``, an array of (class,
    method) or (class, method, lib) (``index.files_of_targets``).  Only classes of
    a file's own targets are tracked, and only calls of its targets are placed,
    cut and put out, with the target's ``lib``.  Files whose targets are null
    are asked for function calls of ``libs`` instead, so that one pass serves
    both kinds: of all APIs, or of those that may be in ``wanted``; a file without
    any of their names isn't parsed.
    """
    src = files.select("file_id", "content", "targets", *keep)
    keep_schema = "".join(f", {f.name} {f.dataType.simpleString()}" for f in src.schema.fields[3:])
    return src.mapInArrow(_pass_fn(libs, want, None, batch_chars, True, fields, wanted),
                          f"file_id bigint, {_rec_schema(fields)}{keep_schema}")


TARGETS = "array<struct<class:string,method:string,lib:string>>"


def files_of_both(functions: DataFrame, methods: DataFrame, libs, keep=()) -> DataFrame:
    """K6: input of one pass for both kinds: files that mention a library, and files with their targets."""
    named = functions.where(F.greatest(*[F.col("content").contains(x) for x in libs], F.lit(False)))
    cols = ["file_id", "content", "targets", *keep]
    return named.withColumn("targets", F.lit(None).cast(TARGETS)).select(*cols).unionByName(
        methods.withColumn("targets", F.col("targets").cast(TARGETS)).select(*cols))


def sites_of_both(recs: DataFrame) -> DataFrame:
    """K6: metadata rows of the records of such a pass, functions and methods, without a join."""
    function = F.col("rec") == "fcall"
    good = (function & (F.col("how") == "first") & F.col("reason").isNull()) | (F.col("rec") == "msite")
    return recs.where(good).select(
        "lib", F.when(function, "function").otherwise("method").alias("kind"), "file_id",
        F.when(function, F.col("name")).otherwise(F.concat_ws(".", "target", "method")).alias("API_path"),
        "repository", "url", F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("last_updated"), "stars",
        F.col("imports").alias("import"), "context", "target_seq", "suffix")


# ----------------------------------------------------------------- functions

def import_text(content: Column) -> Column:
    """F3 in the JVM: distinct one-line imports, first-seen order, each + LF.

    ``(?mdU)`` makes ``^``/``$`` break only at LF and ``\\s`` Unicode-aware,
    as Python's ``re`` does on str.
    """
    pat = (r"(?mdU)^\s*(import\s+\S+(\s+as\s+\S+)?|\s*from\s+\S+\s+import\s+"
           r"(\S+(\s+as\s+\S+)?)?(\s*,\s*\S+(\s+as\s+\S+)?)*)\s*$")
    found = F.array_distinct(F.regexp_extract_all(content, F.lit(pat), 1))
    return F.concat(F.array_join(found, "\n"),
                    F.when(F.size(found) > 0, F.lit("\n")).otherwise(F.lit("")))


def split_call(code: Column, start: Column, end: Column, api_path: Column) -> Column:
    """F8 as one Catalyst expression: struct(ok, reason, api_name, context,
    target_seq, suffix).

    Kept as an independent cross-check of ``split_sample`` (see tests):
    it is correct but costly, since the per-candidate lambdas re-split the
    lines, so the pipelines use the Python split done in the parse pass.

    Lines before the call are context, the call lines are split at the
    longest dotted suffix of the API path that occurs exactly once in them
    (else at the leaf name, between its first and second occurrence).
    """
    lines = F.split(code, "\n", -1)
    n = F.size(lines)
    # clamp so slice() never sees an index < 1; bad spans are masked by ok
    s = F.greatest(start, F.lit(1))
    e = F.greatest(end, s - 1)
    ctx = F.array_join(F.slice(lines, 1, s - 1), "\n")
    calling = F.array_join(F.slice(lines, s, e - s + 1), "\n")
    suffix = F.array_join(F.slice(lines, e + 1, F.greatest(n - e, F.lit(0))), "\n")
    parts = F.split(api_path, r"\.", -1)
    k = F.size(parts)
    names = F.transform(F.sequence(F.lit(1), k),
                        lambda i: F.array_join(F.slice(parts, i, k - i + 1), "."))

    def occurrences(name):
        return F.when(F.length(name) > 0, (F.length(calling) - F.length(
            F.replace(calling, name, F.lit("")))) / F.length(name))

    chosen = F.coalesce(F.get(F.filter(names, lambda x: occurrences(x) == 1), 0),
                        F.get(parts, k - 1))
    at = F.instr(calling, chosen)
    before = F.substring(calling, F.lit(1), at - 1)
    rest = F.substring(calling, at + F.length(chosen), F.lit(1 << 30))
    nxt = F.instr(rest, chosen)
    target = F.when(nxt > 0, F.substring(rest, F.lit(1), nxt - 1)).otherwise(rest)
    valid_lines = (start >= 1) & (end >= start)
    ok = valid_lines & (at > 0)
    reason = (F.when(~valid_lines, F.lit("decorator"))
              .when(at <= 0, F.lit("no_name")))
    return F.struct(
        ok.alias("ok"), reason.alias("reason"),
        F.when(ok, chosen).alias("api_name"),
        F.when(ok, F.concat(ctx, F.lit("\n"), before, chosen)).alias("context"),
        F.when(ok, target).alias("target_seq"),
        F.when(ok, suffix).alias("suffix"))


def function_call_rows(recs: DataFrame) -> DataFrame:
    """All resolved calls (F4 + F6), one row per call, scope def or main."""
    return recs.where(F.col("rec") == "fcall").withColumnRenamed("name", "api_path")


def function_sites(recs: DataFrame, first_only: bool = True) -> DataFrame:
    """T6 rows: first call per (file, lib, API, scope), split into parts.

    The split (F8) is done by the parse pass, where the call is found; a
    row whose split fails keeps ``ok = false`` and a reason (F9).
    """
    f = function_call_rows(recs)
    if first_only:
        f = f.where(F.col("how") == "first")
    return f.withColumn("split", F.struct(
        F.col("reason").isNull().alias("ok"), F.col("reason").alias("reason"),
        F.col("api_name"), F.col("context"), F.col("target_seq"), F.col("suffix")))


def split_samples(df: DataFrame, code: str = "code", start: str = "start_line_no",
                  end: str = "end_line_no", api: str = "API_path") -> DataFrame:
    """F8 over a table of call samples (Arrow-batched Python, the same
    function the parse pass uses); adds struct column ``split``."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("struct<ok:boolean,reason:string,api_name:string,context:string,"
               "target_seq:string,suffix:string>")
    def split(c, s, e, a):
        import pyarrow as pa

        from apidrift.functions.pyparse import split_sample

        ok, reasons, texts = [], [], ([], [], [], [])
        for row in zip(c.to_pylist(), s.to_pylist(), e.to_pylist(), a.to_pylist()):
            parts, reason = split_sample(*row)
            ok.append(parts is not None)
            reasons.append(reason)
            for column, x in zip(texts, parts or (None,) * 4):
                column.append(x)
        return pa.StructArray.from_arrays(
            [pa.array(ok, pa.bool_()), *[pa.array(x, pa.string()) for x in (reasons, *texts)]],
            names=["ok", "reason", "api_name", "context", "target_seq", "suffix"])

    return df.withColumn("split", split(F.col(code), F.col(start), F.col(end), F.col(api)))


def t6(sites: DataFrame) -> DataFrame:
    """Reference metadata columns (F10: time as text) of good call sites."""
    return sites.where("split.ok").select(
        "file_id", "lib", "scope", F.col("api_path").alias("API_path"),
        "repository", "url",
        F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("last_updated"),
        "stars", F.col("imports").alias("import"),
        F.col("split.context").alias("context"),
        F.col("split.target_seq").alias("target_seq"),
        F.col("split.suffix").alias("suffix"))


def with_reasons(recs: DataFrame) -> DataFrame:
    """The few records that tell why something failed, kept for ``rejects``, which reads them twice."""
    return checkpoint(recs.where("reason IS NOT NULL"))


def rejects(recs: DataFrame, sites: DataFrame) -> DataFrame:
    """counts per reason: files that do not parse, calls that do not split."""
    errs = recs.where(F.col("rec") == "error").select(F.col("reason"))
    bad = sites.where(~F.col("split.ok")).select(F.col("split.reason").alias("reason"))
    return errs.unionByName(bad).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------- methods

def method_targets(changes_or_catalog: DataFrame) -> DataFrame:
    """M1: (lib, api_path, class, method) of method APIs; ``__init__`` skipped."""
    t = changes_or_catalog.where(F.col("kind") == "method").select("lib", "api_path").distinct()
    t = t.withColumn("method", F.substring_index("api_path", ".", -1)).withColumn(
        "class", F.expr("substring(api_path, 1, length(api_path) - length(method) - 1)"))
    return t.where(F.col("method") != "__init__")


def of_targets(recs: DataFrame, targets: DataFrame) -> DataFrame:
    """Records of target methods, with their API path.

    A plain equi-join: the size of ``targets`` at run time decides whether
    it is broadcast.
    """
    t = targets.select("lib", "api_path", F.col("class").alias("target"), "method")
    return recs.drop("lib").join(t, ["target", "method"])


def method_calls(recs: DataFrame, targets: DataFrame) -> DataFrame:
    """M6: calls ``x.m(...)`` on variables typed with a target class."""
    m = of_targets(recs.where(F.col("rec") == "mcall"), targets)
    return m.withColumnRenamed("name", "var").withColumnRenamed("target", "class")


def placed_lines(recs: DataFrame, targets: DataFrame) -> DataFrame:
    """K2: each call line of a target method with the block that holds it."""
    m = of_targets(recs.where(F.col("rec") == "mline"), targets)
    return m.withColumnRenamed("btype", "block_type")


def cut_lines(recs: DataFrame, targets: DataFrame) -> DataFrame:
    """K3: call lines cut into context, target_seq and suffix."""
    return of_targets(recs.where(F.col("rec") == "mcut"), targets)


META_COLS = ("repository", "url", "last_updated", "stars")


def method_sites(recs: DataFrame, targets: DataFrame) -> DataFrame:
    """K4: one row per (API, file, block): the first call line in a block
    whose cut succeeds; one call per line (the last variable wins).
    """
    m = of_targets(recs.where(F.col("rec") == "msite"), targets)
    return m.select(
        "file_id", "lib", "api_path", "line", "block_no", F.col("btype").alias("block_type"), *META_COLS,
        F.col("imports").alias("import"), "context", "target_seq", "suffix")
