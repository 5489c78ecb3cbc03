"""Derived test tables, built by SQL from the driver tables.

The same SQL text runs in Spark and in DuckDB (the oracle side); only
table references and the ordered string aggregate differ, and both are
rendered by ``Dialect``. The oracle computes expected results from the
same columns without parsing any generated text, so the two sides are
independent.

Common names (fixed values):
  lib            = 'lib' || pk % 3
  function path  = lib || '.m' || pk % 7 || '.f' || pk
  method path    = lib || '.C' || pk || '.run'
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apidrift.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


@dataclass(frozen=True)
class Dialect:
    name: str  # "spark" or "duckdb"

    def t(self, name: str) -> str:
        """Table reference: a kwargs slot for spark.sql, a view for DuckDB."""
        return "{" + name + "}" if self.name == "spark" else name

    def agg(self, expr: str, sep: str, order: str) -> str:
        """Ordered string aggregate."""
        if self.name == "spark":
            return f"listagg({expr}, {sep}) WITHIN GROUP (ORDER BY {order})"
        return f"string_agg({expr}, {sep} ORDER BY {order})"


SPARK = Dialect("spark")
DUCK = Dialect("duckdb")

NL = "chr(10)"


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run fixture SQL in Spark with the driver tables bound by name."""
    used = {n: table(spark, sf_dir, n) for n in TABLES if "{" + n + "}" in sql}
    return spark.sql(sql, **used)


# ---------------------------------------------------------------------------
# Two API catalogs from `part`.
# v = pk % 10 picks the change case; old side absent for v = 1, new side
# absent for v = 0. Special forms that never parse: no bracket
# (v = 2, pk % 20 = 12) and a `$self` text signature (v = 6, pk % 20 = 16).
# ---------------------------------------------------------------------------

# Argument lists of the catalog fixture.
OLD_ARGS = "(x, y=1, *, k=2)"
NEW_ARGS = {
    3: "(x, z, y=1, *, k=2)",
    4: "(x, y=1)",
    5: "(x, *, y=1, k=2)",
    7: "(x, y=9, *, k=2)",
    8: "(x: int, y: int = 1, *, k=2) -> int",
    9: "(x=0, y=1, *, k=2)",
}
REPR_ARGS = "(x, y=<object object at 0x7f00>, *, k=2)"   # v = 7, pk % 20 = 17
SELF_ARGS = "($self, x, y=1, *, k=2)"                    # v = 6, pk % 20 = 16


def catalog_base_sql(d: Dialect, shift: int = 0) -> str:
    """One row per part: both sides of the catalog entry, plus pk and v.

    ``shift`` moves which parts fall in which change case
    (v = (pk + shift) % 10), so tests can vary the fixture."""
    new_cases = " ".join(
        f"WHEN v = {v} THEN '{a}'" for v, a in NEW_ARGS.items() if v != 7)
    return f"""
SELECT pk, v, lib, kind, api_path, old_args, new_args,
  CASE WHEN v = 1 THEN NULL ELSE api_path || old_args END AS old_signature,
  CASE WHEN v = 0 THEN NULL ELSE api_path || new_args END AS new_signature,
  CASE WHEN v = 1 THEN NULL ELSE doc END AS old_doc,
  CASE WHEN v = 0 THEN NULL WHEN v = 6 THEN doc || ' (revised)' ELSE doc END AS new_doc
FROM (
  SELECT pk, v, lib, kind, api_path, doc,
    CASE WHEN v = 2 AND pk % 20 = 12 THEN ''
         WHEN v = 6 AND pk % 20 = 16 THEN '{SELF_ARGS}'
         ELSE '{OLD_ARGS}' END AS old_args,
    CASE WHEN v = 2 AND pk % 20 = 12 THEN ''
         WHEN v = 6 AND pk % 20 = 16 THEN '{SELF_ARGS}'
         WHEN v = 7 AND pk % 20 = 17 THEN '{REPR_ARGS}'
         WHEN v = 7 THEN '{NEW_ARGS[7]}'
         {new_cases}
         ELSE '{OLD_ARGS}' END AS new_args
  FROM (
    SELECT pk, v, lib, kind,
      CASE WHEN kind = 'function'
           THEN lib || '.m' || CAST(pk % 7 AS STRING) || '.f' || CAST(pk AS STRING)
           ELSE lib || '.C' || CAST(pk AS STRING) || '.run' END AS api_path,
      CASE WHEN pk % 11 = 0 THEN NULL
           ELSE 'Doc of part ' || CAST(pk AS STRING) END AS doc
    FROM (
      SELECT p_partkey AS pk, (p_partkey + {int(shift)}) % 10 AS v,
        'lib' || CAST(p_partkey % 3 AS STRING) AS lib,
        CASE WHEN floor(p_partkey / 10) % 2 = 0 THEN 'function' ELSE 'method' END AS kind
      FROM {d.t('part')}
    ) a
  ) b
) c
"""


def catalog_sql(d: Dialect, shift: int = 0) -> str:
    """X1 as T2 rows: (lib, version, kind, api_path, signature, doc)."""
    base = catalog_base_sql(d, shift)
    return f"""
SELECT lib, '1.0' AS version, kind, api_path, old_signature AS signature, old_doc AS doc
FROM ({base}) o WHERE v <> 1
UNION ALL
SELECT lib, '2.0' AS version, kind, api_path, new_signature AS signature, new_doc AS doc
FROM ({base}) n WHERE v <> 0
"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, catalog_sql(SPARK))


# ---------------------------------------------------------------------------
# Corpus of Python files for function calls, one file per order, one
# `def g{n}` per line item calling the item's API. Import style by
# l_orderkey % 3: 0 `import libI as LI`, 1 `from libI.mJ import fK`
# (renamed `as hK` when pk % 17 = 0), 2 `import libI`. Files with
# file_id % 4 = 0 end with a top-level call of item 1; files with
# file_id % 97 = 0 end with a line that does not parse.
# ---------------------------------------------------------------------------

LIBS = ("lib0", "lib1", "lib2")

ITEM_ORDER = ("l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate")


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


def items_sql(d: Dialect) -> str:
    """One row per line item: file_id, n, pk, lib, api_path, style,
    renamed, import_line, call_name, def_text."""
    mod = "'.m' || " + _s("pk % 7")
    return f"""
SELECT file_id, n, pk, lib, api_path, style, renamed, import_line, call_name,
  'def g' || {_s('n')} || '(a):' || {NL} || '    b = a' || {NL} ||
  '    r = ' || call_name || '(b, ' || {_s('n')} || ')' || {NL} || '    return r' AS def_text
FROM (
  SELECT file_id, n, pk, lib, style, renamed,
    lib || {mod} || '.f' || {_s('pk')} AS api_path,
    CASE WHEN style = 0 THEN 'import ' || lib || ' as L' || {_s('pk % 3')}
         WHEN style = 1 THEN 'from ' || lib || {mod} || ' import f' || {_s('pk')}
              || CASE WHEN renamed THEN ' as h' || {_s('pk')} ELSE '' END
         ELSE 'import ' || lib END AS import_line,
    CASE WHEN style = 0 THEN 'L' || {_s('pk % 3')} || {mod} || '.f' || {_s('pk')}
         WHEN style = 1 THEN CASE WHEN renamed THEN 'h' ELSE 'f' END || {_s('pk')}
         ELSE lib || {mod} || '.f' || {_s('pk')} END AS call_name
  FROM (
    SELECT l_orderkey AS file_id, l_partkey AS pk,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY {ITEM_ORDER}) AS n,
      l_orderkey % 3 AS style,
      'lib' || {_s('l_partkey % 3')} AS lib,
      (l_orderkey % 3 = 1 AND l_partkey % 17 = 0) AS renamed
    FROM {d.t('lineitem')}
  ) a
) b
"""


def files_sql(d: Dialect) -> str:
    """X2 files: file_id, repository, url, content, header, n_header, first_call."""
    items = items_sql(d)
    return f"""
SELECT h.file_id,
  'repo' || {_s('h.file_id % 1000')} AS repository,
  'repo' || {_s('h.file_id % 1000')} || '/src/f' || {_s('h.file_id')} || '.py' AS url,
  h.header || {NL} || b.body
    || CASE WHEN h.file_id % 4 = 0
            THEN {NL} || 'result = ' || b.first_call || '(0, 0)' || {NL} ELSE '' END
    || CASE WHEN h.file_id % 97 = 0 THEN 'def broken(:' || {NL} ELSE '' END AS content,
  h.header, h.n_header, b.first_call
FROM (
  SELECT file_id, {d.agg(f"import_line || {NL}", "''", "import_line")} AS header,
    count(*) AS n_header
  FROM (SELECT DISTINCT file_id, import_line FROM ({items}) i0) u
  GROUP BY file_id
) h JOIN (
  SELECT file_id, {d.agg(f"def_text || {NL}", NL, "n")} AS body,
    max(CASE WHEN n = 1 THEN call_name END) AS first_call
  FROM ({items}) i1 GROUP BY file_id
) b ON h.file_id = b.file_id
"""


def facts_sql(d: Dialect) -> str:
    """X4 repository facts per file; none for file_id % 50 = 7."""
    return f"""
SELECT o_orderkey AS file_id, CAST(floor(c_acctbal) AS BIGINT) AS stars,
  o_orderdate AS last_updated
FROM {d.t('orders')} JOIN {d.t('customer')} ON o_custkey = c_custkey
WHERE o_orderkey % 50 <> 7
"""


def corpus_sql(d: Dialect) -> str:
    """T1 raw snippets + file_id: facts left-joined (NULL when unknown)."""
    return f"""
SELECT f.file_id, f.repository, f.url, x.last_updated, x.stars, f.content
FROM ({files_sql(d)}) f LEFT JOIN ({facts_sql(d)}) x ON f.file_id = x.file_id
"""


# Rows of lineitem or orders that a task takes in: what it gathers stays well within memory, however long the tables are.
ROWS_PER_TASK = 200_000


def _by_file(spark: SparkSession, rows: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` dealt out by file_id, to as many tasks as ``n_rows`` ask for."""
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-n_rows // ROWS_PER_TASK)), "file_id")


def _order_items(spark: SparkSession, sf_dir: str, item: str) -> DataFrame:
    """(file_id, items): the items of each order in ITEM_ORDER, gathered by one narrow shuffle.

    ``item``: texts made of a row's file_id and pk, once the rows lie where they are
    gathered.  Items that agree in line number and part give the same text, so the
    further columns of ITEM_ORDER decide nothing and don't travel.
    """
    lines = table(spark, sf_dir, "lineitem")
    items = lines.selectExpr("l_orderkey AS file_id", "l_linenumber", "l_partkey AS pk").where("file_id IS NOT NULL")
    texts = _by_file(spark, items, lines.count()).selectExpr("file_id", f"struct(l_linenumber, pk, {item}) AS item")
    return texts.groupBy("file_id").agg(F.sort_array(F.collect_list("item")).alias("items"))


def _joined(items: DataFrame, defs: str) -> DataFrame:
    """``items`` with ``defs``, the distinct imports of a file in order as ``header``, and its defs as ``body``."""
    # null where there is nothing to put together, as an aggregate over nulls has it
    return items.withColumn("defs", F.expr(defs)).withColumn("lines", F.expr(
        "array_compact(sort_array(array_distinct(items.line)))")).withColumn("header", F.expr(
            f"CASE WHEN size(lines) > 0 THEN array_join(lines, {NL}) || {NL} END")).withColumn("body", F.expr(
                f"CASE WHEN size(array_compact(defs)) > 0 THEN array_join(defs, {NL} || {NL}) || {NL} END"))


def _made(files: DataFrame, content: str) -> DataFrame:
    """file_id and content, which what follows takes as it is: filters on it don't have it made once more."""
    return files.selectExpr("file_id", f"explode(array({content})) AS content")


def _function_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rows of ``files_sql`` are put together from, made from each order's items at once."""
    lib, mod = f"'lib' || {_s('pk % 3')}", f"'.m' || {_s('pk % 7')}"
    renamed = "file_id % 3 = 1 AND pk % 17 = 0"
    items = _order_items(spark, sf_dir, f"""
        CASE WHEN file_id % 3 = 0 THEN 'import ' || {lib} || ' as L' || {_s('pk % 3')}
             WHEN file_id % 3 = 1 THEN 'from ' || {lib} || {mod} || ' import f' || {_s('pk')}
                  || CASE WHEN {renamed} THEN ' as h' || {_s('pk')} ELSE '' END
             ELSE 'import ' || {lib} END AS line,
        CASE WHEN file_id % 3 = 0 THEN 'L' || {_s('pk % 3')} || {mod} || '.f' || {_s('pk')}
             WHEN file_id % 3 = 1 THEN CASE WHEN {renamed} THEN 'h' ELSE 'f' END || {_s('pk')}
             ELSE {lib} || {mod} || '.f' || {_s('pk')} END AS call""")
    return _joined(items, f"""transform(items.call, (c, i) ->
        'def g' || {_s('i + 1')} || '(a):' || {NL} || '    b = a' || {NL} ||
        '    r = ' || c || '(b, ' || {_s('i + 1')} || ')' || {NL} || '    return r')""")


def _function_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(_function_parts(spark, sf_dir), f"""header || {NL} || body
        || CASE WHEN file_id % 4 = 0 THEN {NL} || 'result = ' || items[0].call || '(0, 0)' || {NL} ELSE '' END
        || CASE WHEN file_id % 97 = 0 THEN 'def broken(:' || {NL} ELSE '' END""")


def _with_facts(spark: SparkSession, sf_dir: str, files: DataFrame, letter: str) -> DataFrame:
    """Names and facts for files, which stay where they were made: only facts travel."""
    named = files.selectExpr("file_id", f"'repo' || {_s('file_id % 1000')} AS repository",
                             f"'repo' || {_s('file_id % 1000')} || '/src/{letter}' || {_s('file_id')} || '.py' AS url", "content")
    # as many tasks as the files have, which need not move
    facts = _by_file(spark, run_sql(spark, sf_dir, facts_sql(SPARK)), table(spark, sf_dir, "lineitem").count())
    return named.join(facts.hint("shuffle_hash"), "file_id", "left").select(
        "file_id", "repository", "url", "last_updated", "stars", "content")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``corpus_sql``; the SQL numbers, sorts and puts together the items twice."""
    return _with_facts(spark, sf_dir, _function_files(spark, sf_dir), "f")


# ---------------------------------------------------------------------------
# X2 with flaws (file_id % 97 <> 0), by file_id % 5: 0 an indent where none
# belongs, 1 tabs and spaces mixed, 2 more nesting than a parser takes, 3 a call
# in a decorator (its lines lie before the def's), 4 none.
# ---------------------------------------------------------------------------

FLAWED = f"""content || CASE file_id % 5
    WHEN 0 THEN '  x = 1' || {NL}
    WHEN 1 THEN 'if 1:' || {NL} || chr(9) || 'y = 1' || {NL} || '        z = 2' || {NL}
    WHEN 2 THEN 'x = ' || repeat('-', 20000) || '1' || {NL}
    WHEN 3 THEN {NL} || '@lib0.deco.f0(2)' || {NL} || 'def deco(a):' || {NL} || '    return a' || {NL}
    ELSE '' END AS content"""


def flawed_sql(d: Dialect) -> str:
    return f"""
SELECT file_id, {FLAWED}
FROM ({files_sql(d)}) f WHERE file_id % 97 <> 0
"""


def flawed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _function_files(spark, sf_dir).where("file_id % 97 <> 0").selectExpr("file_id", FLAWED)


# ---------------------------------------------------------------------------
# Corpus for method calls, one file per order, one `def h{n}` per line
# item using class lib.C{pk} and its method `run`. Import style by
# l_orderkey % 2: 0 `import libI` (dotted names), 1 `from libI import C{pk}`.
# Form by n % 3: 0 variable assigned from the constructor, 1 parameter
# annotated with the class, 2 untyped parameter (must not match).
# Files with file_id % 4 = 0 end with top-level code using item 1's class:
# an assignment, a method call and a bare constructor call.
# ---------------------------------------------------------------------------


def mitems_sql(d: Dialect) -> str:
    """One row per line item: file_id, n, pk, lib, cls, api_path, style,
    form, ctor, import_line, def_text, n_lines."""
    n = _s("n")
    return f"""
SELECT file_id, n, pk, lib, cls, cls || '.run' AS api_path, style, form, ctor, import_line,
  CASE WHEN form = 0
       THEN 'def h' || {n} || '(a):' || {NL} || '    c' || {n} || ' = ' || ctor || '(a)'
            || {NL} || '    return c' || {n} || '.run(a, (a + 1) * 2)'
       WHEN form = 1
       THEN 'def h' || {n} || '(c' || {n} || ': ' || ctor || ', a):' || {NL}
            || '    return c' || {n} || '.run(a)'
       ELSE 'def h' || {n} || '(c' || {n} || ', a):' || {NL}
            || '    return c' || {n} || '.run(a)' END AS def_text,
  CASE WHEN form = 0 THEN 3 ELSE 2 END AS n_lines
FROM (
  SELECT file_id, n, pk, lib, style, n % 3 AS form,
    lib || '.C' || {_s('pk')} AS cls,
    CASE WHEN style = 0 THEN lib || '.C' || {_s('pk')} ELSE 'C' || {_s('pk')} END AS ctor,
    CASE WHEN style = 0 THEN 'import ' || lib
         ELSE 'from ' || lib || ' import C' || {_s('pk')} END AS import_line
  FROM (
    SELECT l_orderkey AS file_id, l_partkey AS pk,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY {ITEM_ORDER}) AS n,
      l_orderkey % 2 AS style,
      'lib' || {_s('l_partkey % 3')} AS lib
    FROM {d.t('lineitem')}
  ) a
) b
"""


def mfiles_sql(d: Dialect) -> str:
    """X3 files: file_id, repository, url, content, header, import_block,
    n_header, first_ctor."""
    items = mitems_sql(d)
    return f"""
SELECT h.file_id,
  'repo' || {_s('h.file_id % 1000')} AS repository,
  'repo' || {_s('h.file_id % 1000')} || '/src/m' || {_s('h.file_id')} || '.py' AS url,
  h.header || {NL} || b.body
    || CASE WHEN h.file_id % 4 = 0
            THEN {NL} || 'g = ' || b.first_ctor || '(0)' || {NL} || 'g.run(1)' || {NL}
                 || b.first_ctor || '(2)' || {NL}
            ELSE '' END AS content,
  h.header, h.import_block, h.n_header, b.first_ctor
FROM (
  SELECT file_id, {d.agg(f"import_line || {NL}", "''", "import_line")} AS header,
    {d.agg("import_line", NL, "import_line")} AS import_block,
    count(*) AS n_header
  FROM (SELECT DISTINCT file_id, import_line FROM ({items}) i0) u
  GROUP BY file_id
) h JOIN (
  SELECT file_id, {d.agg(f"def_text || {NL}", NL, "n")} AS body,
    max(CASE WHEN n = 1 THEN ctor END) AS first_ctor
  FROM ({items}) i1 GROUP BY file_id
) b ON h.file_id = b.file_id
"""


def mcorpus_sql(d: Dialect) -> str:
    return f"""
SELECT f.file_id, f.repository, f.url, x.last_updated, x.stars, f.content
FROM ({mfiles_sql(d)}) f LEFT JOIN ({facts_sql(d)}) x ON f.file_id = x.file_id
"""


def mcorpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``mcorpus_sql``, made as those of ``corpus`` are."""
    lib, leaf = f"'lib' || {_s('pk % 3')}", f"'C' || {_s('pk')}"
    items = _order_items(spark, sf_dir, f"""
        CASE WHEN file_id % 2 = 0 THEN 'import ' || {lib} ELSE 'from ' || {lib} || ' import ' || {leaf} END AS line,
        CASE WHEN file_id % 2 = 0 THEN {lib} || '.' || {leaf} ELSE {leaf} END AS ctor""")
    n = _s("i + 1")
    files = _joined(items, f"""transform(items.ctor, (c, i) ->
        CASE WHEN (i + 1) % 3 = 0
             THEN 'def h' || {n} || '(a):' || {NL} || '    c' || {n} || ' = ' || c || '(a)'
                  || {NL} || '    return c' || {n} || '.run(a, (a + 1) * 2)'
             WHEN (i + 1) % 3 = 1
             THEN 'def h' || {n} || '(c' || {n} || ': ' || c || ', a):' || {NL}
                  || '    return c' || {n} || '.run(a)'
             ELSE 'def h' || {n} || '(c' || {n} || ', a):' || {NL}
                  || '    return c' || {n} || '.run(a)' END)""")
    files = _made(files, f"""header || {NL} || body
        || CASE WHEN file_id % 4 = 0
                THEN {NL} || 'g = ' || items[0].ctor || '(0)' || {NL} || 'g.run(1)' || {NL} || items[0].ctor || '(2)' || {NL}
                ELSE '' END""")
    return _with_facts(spark, sf_dir, files, "m")


# ---------------------------------------------------------------------------
# Marker log from `events`, one line per event in event_id order.
# signup -> file marker lib-m-f{user_id % 3}.jsonl, view -> record marker,
# click -> call of f{user_id % 3}, purchase -> other call, error -> noise.
# ---------------------------------------------------------------------------

# ASCII marker patterns used by the log fixture.
LOG_FILE_RE = r"^Processing file:\s+(.+\.jsonl)$"
LOG_RECORD_RE = r"^Record\s+(\d+)$"
LOG_CALL_RE = r"^Line\s+(\d+):\s+(.+)$"


def log_sql(d: Dialect) -> str:
    return f"""
SELECT 'events' AS log_id, event_id AS line_no,
  CASE WHEN event_type = 'signup'
         THEN 'Processing file: lib-m-f' || {_s('user_id % 3')} || '.jsonl'
       WHEN event_type = 'view' THEN 'Record ' || {_s('event_id % 50 + 1')}
       WHEN event_type = 'click'
         THEN '  Line ' || {_s('event_id % 40 + 1')} || ': c.f' || {_s('user_id % 3')} || '(...)'
       WHEN event_type = 'purchase'
         THEN '  Line ' || {_s('event_id % 40 + 1')} || ': c = other(...)'
       ELSE 'ERROR ' || {_s('event_id')} END AS line
FROM {d.t('events')}
"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, log_sql(SPARK))


# ---------------------------------------------------------------------------
# T13 legacy samples (import, code) from X2: item 1 of each file, its def
# indented by four spaces; files with file_id % 5 = 0 get a trailing comma
# on the last import line.
# ---------------------------------------------------------------------------

def legacy_sql(d: Dialect) -> str:
    return f"""
SELECT f.file_id,
  CASE WHEN f.file_id % 5 = 0
       THEN substring(f.header, 1, length(f.header) - 1) || ',' || {NL}
       ELSE f.header END AS import,
  '    ' || replace(i.def_text, {NL}, {NL} || '    ') AS code
FROM ({files_sql(d)}) f JOIN ({items_sql(d)}) i ON f.file_id = i.file_id AND i.n = 1
"""


def legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _function_parts(spark, sf_dir).selectExpr("file_id", f"""CASE WHEN file_id % 5 = 0
        THEN substring(header, 1, length(header) - 1) || ',' || {NL} ELSE header END AS import""",
        f"'    ' || replace(defs[0], {NL}, {NL} || '    ') AS code")


# ---------------------------------------------------------------------------
# A completion "model" that is a pure function of the row: answers
# with both fences, the second one missing on attempt 1 when
# file_id % 13 = 0, and never well-formed when file_id % 17 = 0.
# ---------------------------------------------------------------------------

def completion(pdf) -> list:
    out = []
    for fid, api, t, a in zip(pdf["file_id"], pdf["API_path"], pdf["target_seq"],
                              pdf["attempt"]):
        leaf = api.rsplit(".", 1)[-1]
        latest = "Latest answer:\n```python\n" + leaf + "_v2" + t + "\n```\n"
        if fid % 17 == 0:
            out.append("I cannot answer that.")
        elif fid % 13 == 0 and a == 1:
            out.append(latest + "Outdated answer:\n```python\n" + t)
        else:
            out.append(latest + "Outdated answer:\n```python\n" + t + "\n```")
    return out


# ---------------------------------------------------------------------------
# Library sources (lib, version, path, content) for the X1 catalogs:
# lib/m{j}.py with `def f{pk}` (+ a private twin `_p{pk}`) for function
# entries, lib/__init__.py with `class C{pk}` (__init__, run, _hidden) for
# method entries, and a stub lib/m0.pyi with other arguments. Argument
# forms that are not Python source (no bracket, $self, object reprs) are
# written in their plain form.
# ---------------------------------------------------------------------------

STUB_ARGS = "(x, y=1, *, k=2, extra=None)"
# classes with pk % 4 = 0 derive from it and inherit `reset`
BASE_CLASS = ("'class Base:' || chr(10) || '    def reset(self, hard=False):' || chr(10)"
              " || '        \"\"\"Reset state.\"\"\"' || chr(10) || '        return 0' || chr(10)")


def source_args_sql(col: str) -> str:
    return (f"CASE WHEN {col} IN ('', '{SELF_ARGS}') THEN '{OLD_ARGS}' "
            f"WHEN {col} = '{REPR_ARGS}' THEN '{NEW_ARGS[7]}' ELSE {col} END")


def lib_sides_sql(d: Dialect) -> str:
    base = catalog_base_sql(d)
    return f"""
SELECT lib, '1.0' AS version, kind, pk, pk % 7 AS m, api_path,
  {source_args_sql('old_args')} AS args, old_doc AS doc FROM ({base}) o WHERE v <> 1
UNION ALL
SELECT lib, '2.0' AS version, kind, pk, pk % 7 AS m, api_path,
  {source_args_sql('new_args')} AS args, new_doc AS doc FROM ({base}) n WHERE v <> 0
"""


def lib_files_sql(d: Dialect) -> str:
    sides = lib_sides_sql(d)
    doc4 = f"CASE WHEN doc IS NULL THEN '' ELSE '    \"\"\"' || doc || '\"\"\"' || {NL} END"
    doc8 = f"CASE WHEN doc IS NULL THEN '' ELSE '        \"\"\"' || doc || '\"\"\"' || {NL} END"
    fn = (f"'def f' || {_s('pk')} || args || ':' || {NL} || {doc4} || '    return 0' || {NL}"
          f" || {NL} || 'def _p' || {_s('pk')} || '(a):' || {NL} || '    return 0' || {NL}")
    cls = (f"'class C' || {_s('pk')} || CASE WHEN pk % 4 = 0 THEN '(Base)' ELSE '' END"
           f" || ':' || {NL} || '    def __init__(self, a):' || {NL}"
           f" || '        self.a = a' || {NL} || {NL}"
           f" || '    def run(self, ' || substring(args, 2) || ':' || {NL} || {doc8}"
           f" || '        return 0' || {NL} || {NL} || '    def _hidden(self):' || {NL}"
           f" || '        return 0' || {NL}")
    stub = (f"'def f' || {_s('pk')} || '{STUB_ARGS} -> None: ...'")
    return f"""
SELECT lib, version, lib || '/m' || {_s('m')} || '.py' AS path,
  {d.agg(fn, NL, 'pk')} AS content
FROM ({sides}) a WHERE kind = 'function' GROUP BY lib, version, m
UNION ALL
SELECT lib, version, lib || '/__init__.py' AS path,
  {BASE_CLASS} || {NL} || {d.agg(cls, NL, 'pk')} AS content
FROM ({sides}) b WHERE kind = 'method' GROUP BY lib, version
UNION ALL
SELECT lib, version, lib || '/m0.pyi' AS path, {d.agg(stub, NL, 'pk')} AS content
FROM ({sides}) c WHERE kind = 'function' AND m = 0 GROUP BY lib, version
"""


def lib_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, lib_files_sql(SPARK))


# ---------------------------------------------------------------------------
# A supplied catalog of text signatures for functions with pk % 5 = 0.
# ---------------------------------------------------------------------------

TEXT_ARGS = "($module, x, y=1, /)"


def supplied_sql(d: Dialect) -> str:
    return f"""
SELECT lib, version, 'function' AS kind, api_path, api_path || '{TEXT_ARGS}' AS signature, doc
FROM ({lib_sides_sql(d)}) a WHERE kind = 'function' AND pk % 5 = 0
"""


def supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, supplied_sql(SPARK))
