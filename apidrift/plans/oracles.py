"""DuckDB oracle SQL, one per registered query.

Every oracle works from the driver-table columns that the fixture text
was made from; none parses generated text. The fixture CTEs are the same
SQL as the Spark side, rendered for DuckDB.
"""

from __future__ import annotations

from apidrift.sources import fixtures as X

D = X.DUCK
ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql.strip()


# ------------------------------------------------------------------ C, D

_SPECIAL = "((v = 2 AND pk % 20 = 12) OR (v = 6 AND pk % 20 = 16))"

_SIDES = f"""
WITH b AS ({X.catalog_base_sql(D)}),
s AS (
  SELECT lib, '1.0' AS version, kind, api_path, v, pk, 'old' AS side FROM b WHERE v <> 1
  UNION ALL
  SELECT lib, '2.0' AS version, kind, api_path, v, pk, 'new' AS side FROM b WHERE v <> 0
)
"""

_CHANGE = """CASE WHEN v = 0 THEN 'deleted' WHEN v = 1 THEN 'added'
  WHEN v IN (3, 9) THEN 'modified_A' WHEN v IN (4, 5) THEN 'modified_B'
  ELSE 'unchanged' END"""

oracle("sig_params", _SIDES + f""",
t AS (
  SELECT lib, version, kind, api_path,
    CASE WHEN {_SPECIAL} THEN NULL
         WHEN side = 'new' AND v = 3 THEN 'x:PK,z:PK,y:PK=,k:KO='
         WHEN side = 'new' AND v = 4 THEN 'x:PK,y:PK='
         WHEN side = 'new' AND v = 5 THEN 'x:PK,y:KO=,k:KO='
         WHEN side = 'new' AND v = 9 THEN 'x:PK=,y:PK=,k:KO='
         ELSE 'x:PK,y:PK=,k:KO=' END AS params_text
  FROM s)
SELECT lib, version, kind, api_path,
  CAST(length(params_text) - length(replace(params_text, ',', '')) + 1 AS BIGINT) AS n_params,
  params_text
FROM t""")

oracle("sig_parse_errors", _SIDES + f"""
SELECT lib, version, CAST(count(*) AS BIGINT) AS n_signatures,
  CAST(sum(CASE WHEN {_SPECIAL} THEN 1 ELSE 0 END) AS BIGINT) AS n_errors
FROM s GROUP BY lib, version""")

oracle("sig_compare", f"""
SELECT lib, kind, api_path,
  CAST(CASE WHEN v IN (3, 9) THEN 2 WHEN v IN (4, 5) THEN 1 ELSE 0 END AS BIGINT) AS code
FROM ({X.catalog_base_sql(D)}) b WHERE v NOT IN (0, 1)""")

oracle("api_changes", f"""
SELECT lib, kind, api_path, {_CHANGE} AS change FROM ({X.catalog_base_sql(D)}) b""")

oracle("api_deleted", f"""
SELECT lib, kind, api_path, old_signature AS signature, old_doc AS doc
FROM ({X.catalog_base_sql(D)}) b WHERE v = 0""")

oracle("api_added", f"""
SELECT lib, kind, api_path, new_signature AS signature, new_doc AS doc
FROM ({X.catalog_base_sql(D)}) b WHERE v = 1""")

oracle("api_modified_a", f"""
SELECT lib, kind, api_path, old_signature, new_signature
FROM ({X.catalog_base_sql(D)}) b WHERE v IN (3, 9)""")

oracle("api_modified_b", f"""
SELECT lib, kind, api_path, old_signature, new_signature
FROM ({X.catalog_base_sql(D)}) b WHERE v IN (4, 5)""")

oracle("api_change_counts", f"""
SELECT lib, kind, change, CAST(count(*) AS BIGINT) AS n_apis,
  CASE change WHEN 'added' THEN 'Added_API' WHEN 'deleted' THEN 'Deleted_API'
    WHEN 'modified_A' THEN 'Modified_API_A' WHEN 'modified_B' THEN 'Modified_API_B'
    ELSE 'Unchanged_API' END AS category
FROM (SELECT lib, kind, {_CHANGE} AS change FROM ({X.catalog_base_sql(D)}) b) c
GROUP BY lib, kind, change""")

oracle("changed_api_lookup", f"""
SELECT lib, kind, api_path AS api_name, {_CHANGE} AS change,
  new_signature AS updated_signature, new_doc AS updated_doc,
  api_path AS outdated_name, old_signature AS outdated_signature,
  old_doc AS outdated_doc
FROM ({X.catalog_base_sql(D)}) b WHERE v IN (3, 4, 5, 9)""")


# ------------------------------------------------------- function call sites

def _with(**ctes: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n"


_F = dict(items=X.items_sql(D), files=X.files_sql(D), facts=X.facts_sql(D))
_CALLNO = "CASE WHEN renamed THEN 'h' ELSE 'f' END || CAST(pk AS VARCHAR)"

oracle("import_aliases", _with(items=_F["items"]) + f"""
SELECT DISTINCT file_id, lib, alias, full_name FROM (
  SELECT file_id, lib,
    CASE WHEN style = 0 THEN 'L' || CAST(pk % 3 AS VARCHAR)
         WHEN style = 1 THEN {_CALLNO} ELSE lib END AS alias,
    CASE WHEN style = 1 THEN api_path ELSE lib END AS full_name
  FROM items
  UNION ALL
  SELECT file_id, lib, lib AS alias, lib AS full_name FROM items
) x WHERE file_id % 97 <> 0""")

oracle("import_text", _with(files=_F["files"]) + """
SELECT file_id, header AS import_text FROM files""")

oracle("function_calls", _with(items=_F["items"], files=_F["files"]) + """
SELECT i.file_id, i.lib, 'def' AS scope, i.api_path,
  row_number() OVER (PARTITION BY i.file_id, i.pk ORDER BY i.n) = 1 AS is_first,
  CAST(f.n_header + 4 + 5 * (i.n - 1) AS BIGINT) AS line
FROM items i JOIN files f ON i.file_id = f.file_id WHERE i.file_id % 97 <> 0
UNION ALL
SELECT file_id, lib, 'main' AS scope, api_path, true AS is_first, CAST(2 AS BIGINT) AS line
FROM items WHERE n = 1 AND file_id % 4 = 0 AND file_id % 97 <> 0""")

_T6_COLS = """i.file_id, i.lib, {scope} AS scope, i.api_path AS API_path, f.repository, f.url,
  strftime(x.last_updated, '%Y-%m-%d %H:%M:%S') AS last_updated,
  COALESCE(x.stars, CAST(0 AS BIGINT)) AS stars"""

_T6_DEF = f"""
SELECT {_T6_COLS.format(scope="'def'")},
  f.header AS import,
  'def g' || CAST(i.n AS VARCHAR) || '(a):' || chr(10) || '    b = a' || chr(10)
    || '    r = ' || i.call_name AS context,
  '(b, ' || CAST(i.n AS VARCHAR) || ')' AS target_seq,
  '    return r' AS suffix
FROM (SELECT *, row_number() OVER (PARTITION BY file_id, pk ORDER BY n) AS k FROM items) i
JOIN files f ON i.file_id = f.file_id LEFT JOIN facts x ON i.file_id = x.file_id
WHERE i.k = 1 AND NOT i.renamed AND i.file_id % 97 <> 0"""

_T6_MAIN = f"""
SELECT {_T6_COLS.format(scope="'main'")},
  '' AS import,
  'def main():' || chr(10) || '    result = ' || i.call_name AS context,
  '(0, 0)' AS target_seq, '' AS suffix
FROM items i JOIN files f ON i.file_id = f.file_id LEFT JOIN facts x ON i.file_id = x.file_id
WHERE i.n = 1 AND i.file_id % 4 = 0 AND NOT i.renamed AND i.file_id % 97 <> 0"""

oracle("function_calls_first", _with(**_F) + _T6_DEF + "\nUNION ALL\n" + _T6_MAIN)

oracle("script_calls", _with(**_F) + f"""
SELECT file_id, API_path, import, context, target_seq, suffix FROM ({_T6_MAIN}) m""")

oracle("split_call", _with(items=_F["items"]) + """
SELECT file_id, api_path,
  CASE WHEN style = 0 THEN 'm' || CAST(pk % 7 AS VARCHAR) || '.f' || CAST(pk AS VARCHAR)
       WHEN style = 1 THEN 'f' || CAST(pk AS VARCHAR) ELSE api_path END AS api_name,
  '(b, ' || CAST(n AS VARCHAR) || ')' AS target_seq
FROM (SELECT *, row_number() OVER (PARTITION BY file_id, pk ORDER BY n) AS k FROM items) i
WHERE k = 1 AND NOT renamed AND file_id % 97 <> 0""")

oracle("call_rejects", _with(items=_F["items"], files=_F["files"]) + """
SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'SyntaxError' AS reason FROM files WHERE file_id % 97 = 0
  UNION ALL
  SELECT 'no_name' FROM (
    SELECT *, row_number() OVER (PARTITION BY file_id, pk ORDER BY n) AS k FROM items) i
  WHERE k = 1 AND renamed AND file_id % 97 <> 0
  UNION ALL
  SELECT 'no_name' FROM items WHERE n = 1 AND file_id % 4 = 0 AND renamed AND file_id % 97 <> 0
) r GROUP BY reason""")


# ------------------------------------------------------------------ retrieval

_CHANGED_FN = f"""
SELECT pk, lib, api_path, 'm' || CAST(pk % 7 AS VARCHAR) AS m, 'f' || CAST(pk AS VARCHAR) AS f
FROM ({X.catalog_base_sql(D)}) b WHERE kind = 'function' AND v IN (3, 4, 5, 9)"""

oracle("api_patterns", _with(c=_CHANGED_FN) + """
SELECT api_path, CAST(k AS BIGINT) AS pattern_no,
  CASE k WHEN 0 THEN api_path WHEN 1 THEN 'import ' || lib || ' as'
    WHEN 2 THEN '.' || m || '.' || f WHEN 3 THEN 'from ' || lib || ' import ' || m
    WHEN 4 THEN '.' || f WHEN 5 THEN 'import ' || lib || '.' || m || ' as'
    WHEN 6 THEN '.' || f WHEN 7 THEN 'from ' || lib || '.' || m || ' import ' || f
    ELSE f END AS pattern
FROM c CROSS JOIN range(9) t(k)""")

oracle("api_queries", _with(c=_CHANGED_FN) + """
SELECT api_path, CAST(q AS BIGINT) AS query_no,
  CASE q WHEN 1 THEN api_path
    WHEN 2 THEN 'import ' || lib || ' as | .' || m || '.' || f
    WHEN 3 THEN 'import ' || lib || '.' || m || ' as | .' || f
    WHEN 4 THEN 'from ' || lib || ' import ' || m || ' | .' || f
    ELSE 'from ' || lib || '.' || m || ' import ' || f || ' | ' || f END AS terms,
  f AS leaf
FROM c CROSS JOIN range(1, 6) t(q)""")

_MATCHES = _with(items=_F["items"], c=_CHANGED_FN, m="""
  SELECT DISTINCT c.api_path,
    CASE WHEN i.style = 0 THEN 2 WHEN i.style = 1 THEN 5 ELSE 1 END AS query_no, i.file_id
  FROM items i JOIN c ON i.pk = c.pk""", t="""
  SELECT q.api_path, q.query_no, COALESCE(n.n, 0) AS n_hits
  FROM (SELECT api_path, r AS query_no FROM c CROSS JOIN range(1, 6) t(r)) q
  LEFT JOIN (SELECT api_path, query_no, count(*) AS n FROM m GROUP BY api_path, query_no) n
    ON q.api_path = n.api_path AND q.query_no = n.query_no""", b="""
  SELECT *, COALESCE(sum(n_hits) OVER (PARTITION BY api_path ORDER BY query_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 12 AS kept FROM t""")

oracle("search_matches", _MATCHES + """
SELECT api_path, CAST(query_no AS BIGINT) AS query_no, file_id FROM m""")

oracle("search_budget", _MATCHES + """
SELECT api_path, CAST(query_no AS BIGINT) AS query_no, CAST(n_hits AS BIGINT) AS n_hits, kept
FROM b""")

oracle("search_counts", _MATCHES + """
SELECT api_path, CAST(sum(n_hits) AS BIGINT) AS n_hits FROM b WHERE kept GROUP BY api_path""")

oracle("search_top_m", _MATCHES + """
SELECT api_path, CAST(rnk AS BIGINT) AS rank, file_id, CAST(query_no AS BIGINT) AS query_no
FROM (
  SELECT *, row_number() OVER (PARTITION BY api_path
                               ORDER BY ceil(place / 100), query_no, place) AS rnk
  FROM (SELECT m.*, row_number() OVER (PARTITION BY m.api_path, m.query_no
                                       ORDER BY m.file_id) AS place
        FROM m JOIN b ON m.api_path = b.api_path AND m.query_no = b.query_no
        WHERE b.kept) p
) r WHERE rnk <= 5""")

oracle("enrich_files", _with(files=_F["files"], facts=_F["facts"]) + """
SELECT f.file_id, f.repository, f.url, COALESCE(x.stars, CAST(0 AS BIGINT)) AS stars,
  COALESCE(strftime(x.last_updated, '%Y-%m-%d %H:%M:%S'), 'Unknown') AS last_updated
FROM files f LEFT JOIN facts x ON f.file_id = x.file_id""")

oracle("filter_files", _with(files=_F["files"], facts=_F["facts"]) + """
SELECT f.file_id FROM files f LEFT JOIN facts x ON f.file_id = x.file_id
WHERE COALESCE(x.stars, 0) >= 0
  AND (x.last_updated IS NULL OR x.last_updated <= TIMESTAMP '1995-06-30 00:00:00')""")

oracle("usage_test", _MATCHES + """
SELECT DISTINCT api_path, file_id, true AS used FROM m""")


# ---------------------------------------------------- method call sites, blocks

_M = dict(mitems=X.mitems_sql(D), mfiles=X.mfiles_sql(D), facts=X.facts_sql(D),
          cat=X.catalog_base_sql(D))
_MX = dict(mi="""
  SELECT i.*, f.n_header,
    f.n_header + 2 + COALESCE(sum(i.n_lines + 1) OVER (PARTITION BY i.file_id ORDER BY i.n
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_line
  FROM mitems i JOIN mfiles f ON i.file_id = f.file_id""", tg="""
  SELECT DISTINCT lib || '.C' || CAST(pk AS VARCHAR) AS cls FROM cat
  WHERE kind = 'method' AND v <> 0""", gl="""
  SELECT file_id, max(start_line + n_lines - 1) AS last_end, count(*) AS k,
    max(CASE WHEN n = 1 THEN cls END) AS cls1,
    max(CASE WHEN n = 1 THEN ctor END) AS ctor1
  FROM mi GROUP BY file_id""")
_MCTE = _with(**_M, **_MX)

_GLOBAL = "g.file_id % 4 = 0 AND g.cls1 IN (SELECT cls FROM tg)"

oracle("typed_vars", _MCTE + f"""
SELECT file_id, 'c' || CAST(n AS VARCHAR) AS var, cls AS class,
  CASE WHEN form = 0 THEN 'assign' ELSE 'param' END AS how
FROM mi WHERE form IN (0, 1) AND cls IN (SELECT cls FROM tg)
UNION ALL
SELECT g.file_id, 'g' AS var, g.cls1 AS class, 'assign' AS how FROM gl g WHERE {_GLOBAL}""")

oracle("constructor_calls", _MCTE + f"""
SELECT file_id, cls AS class, CAST(start_line + 1 AS BIGINT) AS line,
  'c' || CAST(n AS VARCHAR) AS var
FROM mi WHERE form = 0 AND cls IN (SELECT cls FROM tg)
UNION ALL
SELECT g.file_id, g.cls1, CAST(g.last_end + 2 AS BIGINT), 'g' FROM gl g WHERE {_GLOBAL}
UNION ALL
SELECT g.file_id, g.cls1, CAST(g.last_end + 4 AS BIGINT), '<no_assignment>'
FROM gl g WHERE {_GLOBAL}""")

_MCALLS = f"""
SELECT file_id, cls || '.run' AS api_path, CAST(start_line + n_lines - 1 AS BIGINT) AS line,
  'c' || CAST(n AS VARCHAR) AS var, n + 1 AS block_no, 'function' AS block_type,
  CASE WHEN form = 0
       THEN 'def h' || CAST(n AS VARCHAR) || '(a):' || chr(10) || '    c' || CAST(n AS VARCHAR)
            || ' = ' || ctor || '(a)' || chr(10) || '    return c' || CAST(n AS VARCHAR) || '.run'
       ELSE 'def h' || CAST(n AS VARCHAR) || '(c' || CAST(n AS VARCHAR) || ': ' || ctor
            || ', a):' || chr(10) || '    return c' || CAST(n AS VARCHAR) || '.run' END AS context,
  CASE WHEN form = 0 THEN '(a, (a + 1) * 2)' ELSE '(a)' END AS target_seq,
  '' AS suffix
FROM mi WHERE form IN (0, 1) AND cls IN (SELECT cls FROM tg)
UNION ALL
SELECT g.file_id, g.cls1 || '.run', CAST(g.last_end + 3 AS BIGINT), 'g', g.k + 2, 'global',
  'g = ' || g.ctor1 || '(0)' || chr(10) || 'g.run', '(1)', g.ctor1 || '(2)'
FROM gl g WHERE {_GLOBAL}"""

oracle("method_calls", _MCTE + f"""
SELECT file_id, api_path, line, var FROM ({_MCALLS}) c""")

oracle("method_files", _MCTE + f"""
SELECT api_path, file_id, CAST(count(*) AS BIGINT) AS n_calls FROM ({_MCALLS}) c
GROUP BY api_path, file_id""")

oracle("code_blocks", _MCTE + """
SELECT file_id, CAST(1 AS BIGINT) AS block_no, 'imports' AS block_type,
  CAST(NULL AS BIGINT) AS start_line, CAST(NULL AS BIGINT) AS end_line, import_block AS code
FROM mfiles
UNION ALL
SELECT file_id, CAST(n + 1 AS BIGINT), 'function', CAST(start_line AS BIGINT),
  CAST(start_line + n_lines - 1 AS BIGINT), def_text FROM mi
UNION ALL
SELECT g.file_id, CAST(g.k + 2 AS BIGINT), 'global', NULL, NULL,
  repeat(chr(10), CAST(g.k + 1 AS BIGINT)) || 'g = ' || g.ctor1 || '(0)' || chr(10)
    || 'g.run(1)' || chr(10) || g.ctor1 || '(2)'
FROM gl g WHERE g.file_id % 4 = 0""")

oracle("call_block", _MCTE + f"""
SELECT file_id, api_path, line, CAST(block_no AS BIGINT) AS block_no, block_type
FROM ({_MCALLS}) c""")

oracle("split_method_call", _MCTE + f"""
SELECT file_id, api_path, line, context, target_seq, suffix FROM ({_MCALLS}) c""")

_MMETA = f"""
SELECT c.file_id, c.api_path AS API_path, f.repository, f.url,
  strftime(x.last_updated, '%Y-%m-%d %H:%M:%S') AS last_updated,
  COALESCE(x.stars, CAST(0 AS BIGINT)) AS stars, f.import_block AS import,
  c.context, c.target_seq, c.suffix
FROM ({_MCALLS}) c JOIN mfiles f ON c.file_id = f.file_id
LEFT JOIN facts x ON c.file_id = x.file_id"""

oracle("method_metadata", _MCTE + _MMETA)

oracle("metadata", _with(**{**_F, **_M, **_MX}) + f"""
SELECT file_id, API_path, repository, url, last_updated, stars, import, context,
  target_seq, suffix, 'function' AS kind FROM ({_T6_DEF} UNION ALL {_T6_MAIN}) a
UNION ALL
SELECT *, 'method' AS kind FROM ({_MMETA}) b""")


# ---------------------------------------------------------------- marker logs

oracle("marker_log", """
WITH l AS (
  SELECT event_id AS ord, event_type,
    CASE WHEN event_type = 'signup'
         THEN 'lib-m-f' || CAST(user_id % 3 AS VARCHAR) || '.jsonl' END AS fname,
    CASE WHEN event_type = 'signup' THEN event_id END AS fat,
    CASE WHEN event_type = 'signup' THEN 'f' || CAST(user_id % 3 AS VARCHAR) END AS fapi,
    CASE WHEN event_type = 'view' THEN event_id END AS rat,
    CASE WHEN event_type = 'view' THEN event_id % 50 + 1 END AS rno,
    'f' || CAST(user_id % 3 AS VARCHAR) AS capi,
    event_id % 40 + 1 AS cline
  FROM events),
f AS (
  SELECT *,
    last_value(fname IGNORE NULLS) OVER w AS cur_file,
    last_value(fat IGNORE NULLS) OVER w AS cur_fat,
    last_value(fapi IGNORE NULLS) OVER w AS cur_api,
    last_value(rat IGNORE NULLS) OVER w AS cur_rat,
    last_value(rno IGNORE NULLS) OVER w AS cur_rno
  FROM l WINDOW w AS (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (
  SELECT cur_file, cur_api, cur_rno, cline, ord, 'c.' || capi || '(...)' AS call_text
  FROM f
  WHERE event_type = 'click' AND cur_file IS NOT NULL AND cur_rat > cur_fat
    AND capi = cur_api)
SELECT cur_file AS file_name, cur_api AS api_name, CAST(cur_rno AS BIGINT) AS record_no,
  CAST(cline AS BIGINT) AS line_no, call_text
FROM (SELECT *, row_number() OVER (PARTITION BY cur_file, cur_rno, cline ORDER BY ord DESC) AS r
      FROM k) x WHERE r = 1""")


# ---------------------------------------------- conversion, filter, synthesis

oracle("build_content", _with(items=_F["items"], files=_F["files"], hl="""
  SELECT file_id, import_line,
    row_number() OVER (PARTITION BY file_id ORDER BY import_line) AS r,
    count(*) OVER (PARTITION BY file_id) AS h
  FROM (SELECT DISTINCT file_id, import_line FROM items) u""", pre="""
  SELECT file_id,
    COALESCE(string_agg(CASE WHEN r < h THEN import_line END, chr(10) ORDER BY r), '') AS prefix,
    max(CASE WHEN r = h THEN import_line END) AS last_line
  FROM hl GROUP BY file_id""") + """
SELECT f.file_id,
  CASE WHEN f.file_id % 5 = 0 AND f.file_id % 3 = 1
       THEN p.prefix || chr(10) || p.last_line || ',wrong_package' || chr(10)
       WHEN f.file_id % 5 = 0
       THEN substring(f.header, 1, length(f.header) - 1) || ',' || chr(10)
       ELSE f.header END || repeat(chr(10), 4) || i.def_text AS content
FROM files f JOIN items i ON f.file_id = i.file_id AND i.n = 1
JOIN pre p ON f.file_id = p.file_id""")

_ALL = {**_F, **_M, **_MX}
# function rows: def scope carry pk via items; main scope rows below
_FN_ROWS = f"""
  SELECT d.file_id, d.API_path, d.repository, d.url, d.last_updated, d.stars, d.import,
    d.context, d.target_seq, d.suffix, 'function' AS kind, 'f' || CAST(i.pk AS VARCHAR) AS leaf
  FROM ({_T6_DEF}) d JOIN items i ON d.file_id = i.file_id AND d.API_path = i.api_path
  GROUP BY ALL
  UNION ALL
  SELECT d.file_id, d.API_path, d.repository, d.url, d.last_updated, d.stars, d.import,
    d.context, d.target_seq, d.suffix, 'function' AS kind, 'f' || CAST(i.pk AS VARCHAR) AS leaf
  FROM ({_T6_MAIN}) d JOIN items i ON d.file_id = i.file_id AND i.n = 1"""
_ME_ROWS = f"""
  SELECT c.*, 'method' AS kind, 'run' AS leaf FROM ({_MMETA}) c"""
_FILTERED = _with(**_ALL) + f""",
rows AS ({_FN_ROWS} UNION ALL {_ME_ROWS}),
flt AS (
  SELECT r.*, b.v, b.new_signature AS updated_signature, b.old_signature AS outdated_signature,
    b.new_doc AS updated_doc, b.old_doc AS outdated_doc,
    CASE WHEN b.v IN (3, 9) THEN 'modified_A' ELSE 'modified_B' END AS change
  FROM rows r JOIN cat b ON r.API_path = b.api_path AND r.kind = b.kind
  WHERE b.v IN (3, 4, 5, 9)),
syn AS (
  SELECT *, file_id % 17 <> 0 AS ok,
    CASE WHEN file_id % 17 = 0 THEN 5 WHEN file_id % 13 = 0 THEN 2 ELSE 1 END AS attempts,
    CASE WHEN file_id % 17 <> 0 THEN leaf || '_v2' || target_seq END AS updated_code,
    CASE WHEN file_id % 17 <> 0 THEN target_seq END AS outdated_code
  FROM flt)
""".replace(")\n,\nrows AS", "),\nrows AS")
_FILTERED = _FILTERED.replace("\n,\nrows AS (", ",\nrows AS (")

oracle("filter_changed", _FILTERED + """
SELECT kind, file_id, API_path, change,
  CASE WHEN change = 'modified_A' THEN 'Modified_API_A' ELSE 'Modified_API_B' END AS category
FROM flt""")

_USER = ("'Please complete the task according to the requirements outlined above.'"
         " || chr(10) || 'Latest API Signature: ' || updated_signature"
         " || chr(10) || 'Oudated API Signature: ' || outdated_signature"
         " || chr(10) || '---' || chr(10) || 'Context:' || chr(10) || context"
         " || chr(10) || '---' || chr(10) || 'Calling Statement:' || chr(10) || target_seq"
         " || chr(10) || '---' || chr(10) || 'Suffix:' || chr(10) || suffix"
         " || chr(10) || '---' || chr(10) || 'Latest API Docstring: ' || COALESCE(updated_doc, 'None')"
         " || chr(10) || '---' || chr(10) || 'Outdated API Docstring: ' || COALESCE(outdated_doc, 'None')"
         " || chr(10)")

oracle("render_prompt", _FILTERED + f"""
SELECT kind, file_id, API_path, {_USER} AS prompt FROM flt""")

oracle("synthesis_status", _FILTERED + """
SELECT kind, file_id, API_path, CAST(attempts AS BIGINT) AS attempts, ok FROM syn""")

oracle("parse_answer", _FILTERED + """
SELECT kind, file_id, API_path, updated_code, outdated_code FROM syn""")

oracle("synthesize", _FILTERED + """
SELECT kind, file_id, API_path, repository, url, last_updated, stars, import, context,
  suffix, updated_code, outdated_code, updated_signature, outdated_signature
FROM syn WHERE ok""")

oracle("bench_cct", _FILTERED + """
SELECT 'cct' AS task, kind, file_id, API_path, context AS question, updated_code AS answer,
  updated_signature, outdated_signature, repository, url, last_updated, stars
FROM syn WHERE ok""")

oracle("bench_ect", _FILTERED + """
SELECT 'ect' AS task, kind, file_id, API_path, context || chr(10) || outdated_code AS question,
  updated_code AS answer, updated_signature, outdated_signature, repository, url,
  last_updated, stars
FROM syn WHERE ok""")


# ------------------------------------------------------------- prompt batches

_PROMPTS = _with(items=_F["items"], files=_F["files"], pr="""
  SELECT i.file_id,
    CASE WHEN i.style = 0 THEN 'm' || CAST(i.pk % 7 AS VARCHAR) || '.f' || CAST(i.pk AS VARCHAR)
         WHEN i.style = 1 THEN 'f' || CAST(i.pk AS VARCHAR) ELSE i.api_path END AS API_path,
    f.header || 'def g' || CAST(i.n AS VARCHAR) || '(a):' || chr(10) || '    b = a' || chr(10)
      || '    r = ' || i.call_name AS prompt,
    '(b, ' || CAST(i.n AS VARCHAR) || ')' AS targets,
    'def g' || CAST(i.n AS VARCHAR) || '(a):' || chr(10) || '    b = a' || chr(10)
      || '    r = ' || i.call_name AS code,
    f.header AS imports
  FROM (SELECT *, row_number() OVER (PARTITION BY file_id, pk ORDER BY n) AS k FROM items) i
  JOIN files f ON i.file_id = f.file_id
  WHERE i.k = 1 AND NOT i.renamed AND i.file_id % 97 <> 0""")

oracle("prompt_rows", _PROMPTS + "SELECT * FROM pr")

oracle("truncate_left", _PROMPTS + """
SELECT file_id, API_path, CAST(len(t) AS BIGINT) AS n_tokens,
  array_to_string(list_slice(t, greatest(len(t) - 16 + 1, 1), len(t)), ' ') AS tail
FROM (SELECT file_id, API_path, regexp_split_to_array(prompt, '\\s+') AS t FROM pr) x""")

oracle("assign_batches", _PROMPTS + """
SELECT file_id, API_path, CAST(rn AS BIGINT) AS position,
  CAST(floor((rn - 1) / 64) AS BIGINT) AS batch_id
FROM (SELECT file_id, API_path, row_number() OVER (ORDER BY file_id, API_path) AS rn FROM pr) x""")


# ------------------------------------------------------------ sources, sinks

oracle("scan_corpus", _MATCHES.rstrip() + f""",
files AS ({_F['files']}), facts AS ({_F['facts']})
SELECT m.api_path, f.url, COALESCE(x.stars, CAST(0 AS BIGINT)) AS stars,
  COALESCE(strftime(x.last_updated, '%Y-%m-%dT%H:%M:%SZ'), 'Unknown') AS last_updated,
  md5(f.content) AS content_md5
FROM (SELECT api_path, file_id, query_no, row_number() OVER (PARTITION BY api_path
        ORDER BY ceil(place / 100), query_no, place) AS rnk
      FROM (SELECT m.*, row_number() OVER (PARTITION BY m.api_path, m.query_no
                                           ORDER BY m.file_id) AS place
            FROM m JOIN b ON m.api_path = b.api_path AND m.query_no = b.query_no
            WHERE b.kept) p) m
JOIN files f ON m.file_id = f.file_id LEFT JOIN facts x ON m.file_id = x.file_id
WHERE m.rnk <= 5""")

oracle("scan_tolerant", _with(files=_F["files"]) + """
SELECT 'good' AS status, CAST(count(*) AS BIGINT) AS n FROM files
UNION ALL
SELECT 'corrupt', CAST(count(*) AS BIGINT) FROM files WHERE file_id % 9 = 0""")

oracle("roundtrip_jsonl", _with(**_F) + _T6_DEF + "\nUNION ALL\n" + _T6_MAIN)

oracle("sink_by_api", _with(**_F) + f"""
SELECT lib, API_path, CAST(count(*) AS BIGINT) AS n_rows
FROM ({_T6_DEF} UNION ALL {_T6_MAIN}) t GROUP BY lib, API_path""")

oracle("catalog_from_json", X.catalog_sql(D))

oracle("decode_content", _with(files=_F["files"]) + """
SELECT file_id,
  md5(CASE WHEN file_id % 11 = 0 THEN '' ELSE content END) AS content_md5,
  CAST(CASE WHEN file_id % 11 = 0 THEN 0 ELSE length(content) END AS BIGINT) AS n_chars
FROM files""")


# ------------------------------------------------------- catalogs from sources

_SIDES_SRC = _with(s=X.lib_sides_sql(D))

oracle("catalog_functions", _SIDES_SRC + """
SELECT lib, version, api_path, api_path || args AS signature, doc
FROM s WHERE kind = 'function'""")

oracle("catalog_methods", _SIDES_SRC + """
SELECT lib, version, api_path, api_path || '(self, ' || substring(args, 2) AS signature, doc
FROM s WHERE kind = 'method'
UNION ALL
SELECT lib, version, lib || '.C' || CAST(pk AS VARCHAR) || '.__init__' AS api_path,
  lib || '.C' || CAST(pk AS VARCHAR) || '.__init__(self, a)' AS signature, NULL AS doc
FROM s WHERE kind = 'method'
UNION ALL
SELECT DISTINCT lib, version, lib || '.Base.reset' AS api_path,
  lib || '.Base.reset(self, hard=False)' AS signature, 'Reset state.' AS doc
FROM s WHERE kind = 'method'
UNION ALL
SELECT lib, version, lib || '.C' || CAST(pk AS VARCHAR) || '.reset' AS api_path,
  lib || '.C' || CAST(pk AS VARCHAR) || '.reset(self, hard=False)' AS signature,
  'Reset state.' AS doc
FROM s WHERE kind = 'method' AND pk % 4 = 0""")

oracle("catalog_stub", _SIDES_SRC + f"""
SELECT lib, version, api_path,
  CASE WHEN m = 0 THEN api_path || '{X.STUB_ARGS}' ELSE api_path || args END AS signature
FROM s WHERE kind = 'function'""")


oracle("search_methods", _with(**_M, **_MX) + """
SELECT DISTINCT api_path, CAST(query_no AS BIGINT) AS query_no, file_id FROM (
  SELECT c.api_path, CASE WHEN i.style = 0 THEN 1 ELSE 3 END AS query_no, i.file_id
  FROM mi i JOIN cat c ON c.kind = 'method' AND c.v IN (3, 4, 5, 9) AND c.pk = i.pk
  WHERE i.style = 1 OR i.form IN (0, 1)
  UNION ALL
  SELECT c.api_path, 1, g.file_id
  FROM gl g JOIN mi i ON g.file_id = i.file_id AND i.n = 1
  JOIN cat c ON c.kind = 'method' AND c.v IN (3, 4, 5, 9) AND c.pk = i.pk
  WHERE g.file_id % 4 = 0 AND i.style = 0
) x""")

# ------------------------------------------------------------ chains, rejects

oracle("chain_sites", f"""
SELECT f.kind, f.file_id, f.API_path, f.change, f.category
FROM ({ORACLES["filter_changed"]}) f
SEMI JOIN ({ORACLES["search_top_m"]}) t ON f.API_path = t.api_path AND f.file_id = t.file_id
WHERE f.kind = 'function'""")

oracle("synthesis_rejects", f"""
SELECT kind, file_id, API_path, attempts FROM ({ORACLES["synthesis_status"]}) s WHERE NOT ok""")


# ------------------------------------------- the whole chain, answers, versions

# found files: the first five of each API over its queries, budget and all
_FOUND = f"""
SELECT api_path, file_id, 'function' AS kind FROM ({ORACLES["search_top_m"]}) f
UNION ALL
SELECT api_path, file_id, 'method' AS kind FROM (
  SELECT *, row_number() OVER (PARTITION BY api_path ORDER BY ceil(place / 100), query_no, place) AS rnk
  FROM (
    SELECT m.*, row_number() OVER (PARTITION BY m.api_path, m.query_no ORDER BY m.file_id) AS place
    FROM ({ORACLES["search_methods"]}) m JOIN (
      SELECT api_path, query_no, COALESCE(sum(n) OVER (PARTITION BY api_path ORDER BY query_no
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 12 AS kept
      FROM (SELECT api_path, query_no, count(*) AS n FROM ({ORACLES["search_methods"]}) a GROUP BY ALL) t) b
    ON m.api_path = b.api_path AND m.query_no = b.query_no WHERE b.kept) p) r
WHERE rnk <= 5"""
_CHAINED = _FILTERED + f""",
found AS ({_FOUND}),
chained AS (SELECT s.* FROM syn s SEMI JOIN found t
            ON s.API_path = t.api_path AND s.file_id = t.file_id AND s.kind = t.kind)
"""

for _task, _question in (("cct", "context"), ("ect", "context || chr(10) || outdated_code")):
    oracle(f"chain_{_task}", _CHAINED + f"""
SELECT '{_task}' AS task, kind, file_id, API_path, {_question} AS question, updated_code AS answer,
  updated_signature, outdated_signature, repository, url, last_updated, stars
FROM chained WHERE ok""")

oracle("chain_steps", _CHAINED + """,
counts AS (
  SELECT 'update' AS step, 'changes' AS name, count(*) AS n FROM cat
  UNION ALL SELECT 'crawl', 'found', count(*) FROM found
  UNION ALL SELECT 'crawl', 'files', count(*) FROM (SELECT DISTINCT kind, file_id FROM found) x
  UNION ALL SELECT 'convert', '', 0
  UNION ALL SELECT 'extract', 'sites', count(*) FROM chained
  UNION ALL SELECT 'filter', 'sites', count(*) FROM chained
  UNION ALL SELECT 'synthesize', 'metadata', count(*) FROM chained WHERE ok
  UNION ALL SELECT 'synthesize', 'rejects', count(*) FROM chained WHERE NOT ok
  UNION ALL SELECT 'synthesize', 'missing', 0
  UNION ALL SELECT 'benchmark', 'cct', count(*) FROM chained WHERE ok
  UNION ALL SELECT 'benchmark', 'ect', count(*) FROM chained WHERE ok)
SELECT step, name, CAST(n AS BIGINT) AS n_rows, CASE WHEN step = 'convert' THEN 'skipped' ELSE 'kept' END AS second_run,
  CASE WHEN step IN ('extract', 'filter') THEN 'kept' ELSE 'skipped' END AS run_of_two
FROM counts""")

oracle("answer_runs", _FILTERED + """,
keys AS (SELECT count(*) AS n FROM (
  SELECT DISTINCT kind, file_id, API_path, context, target_seq, suffix FROM flt) x)
SELECT 'first two' AS run, CAST(n AS BIGINT) AS n_keys, CAST(n AS BIGINT) AS n_asked, CAST(0 AS BIGINT) AS n_left,
  true AS found_rest FROM keys
UNION ALL
SELECT 'third', CAST(n AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), true FROM keys""")

oracle("synthesis_missing", f"""
SELECT lib, kind, CAST(count(*) AS BIGINT) AS n_apis, CAST(sum(n) AS BIGINT) AS n_sites FROM (
  SELECT split_part(API_path, '.', 1) AS lib, kind, API_path, count(*) AS n
  FROM ({ORACLES["metadata"]}) m
  WHERE (kind, API_path) NOT IN (SELECT kind, api_path FROM ({X.catalog_base_sql(D)}) c WHERE v IN (3, 4, 5, 9))
  GROUP BY ALL) x
GROUP BY lib, kind""")

oracle("replace_in_place", f"""
SELECT *, CAST(1 AS BIGINT) AS n_versions FROM ({ORACLES["synthesize"]}) s""")

oracle("ledger_calls", ORACLES["function_calls"])

oracle("ledger_runs", _with(files=_F["files"]) + """
SELECT CAST(1 AS BIGINT) AS run, CAST(count(*) AS BIGINT) AS n_files, CAST(count(DISTINCT content) AS BIGINT) AS n_contents,
  CAST(count(DISTINCT content) AS BIGINT) AS n_parsed
FROM files WHERE file_id % 10 <> 3
UNION ALL
SELECT 2, count(*), count(DISTINCT content), (SELECT count(DISTINCT content) FROM files)
  - (SELECT count(DISTINCT content) FROM files WHERE file_id % 10 <> 3) FROM files
UNION ALL
SELECT 3, count(*) + count(*) FILTER (file_id % 5 = 0), count(DISTINCT content), 0 FROM files""")

oracle("read_batch", f"""
SELECT *, true AS few_files FROM ({ORACLES["assign_batches"]}) b WHERE batch_id BETWEEN 5 AND 7""")

oracle("sites_by_class", _FILTERED + """
SELECT split_part(API_path, '.', 1) AS lib, kind,
  CASE WHEN change = 'modified_A' THEN 'Modified_API_A' ELSE 'Modified_API_B' END AS category,
  file_id, API_path, target_seq FROM flt""")

oracle("changes_by_class", _with(cat=X.catalog_base_sql(D)) + """
SELECT lib, kind, 'Added_API' AS category, api_path, new_signature AS signature, new_doc AS doc FROM cat WHERE v = 1
UNION ALL SELECT lib, kind, 'Deleted_API', api_path, old_signature, old_doc FROM cat WHERE v = 0
UNION ALL SELECT lib, kind, 'Modified_API_' || CASE WHEN v IN (3, 9) THEN 'A' ELSE 'B' END, api_path, new_signature, new_doc
  FROM cat WHERE v IN (3, 4, 5, 9)
UNION ALL SELECT lib, kind, 'Outdated_API_' || CASE WHEN v IN (3, 9) THEN 'A' ELSE 'B' END, api_path, old_signature, old_doc
  FROM cat WHERE v IN (3, 4, 5, 9)""")

oracle("reject_reasons", _with(items=_F["items"], files=_F["files"]) + """
SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE file_id % 5 WHEN 0 THEN 'IndentationError' WHEN 1 THEN 'TabError' WHEN 2 THEN 'MemoryError'
    ELSE 'decorator' END AS reason
  FROM files WHERE file_id % 97 <> 0 AND file_id % 5 < 4
  UNION ALL
  SELECT 'no_name' FROM (
    SELECT *, row_number() OVER (PARTITION BY file_id, pk ORDER BY n) AS k FROM items) i
  WHERE k = 1 AND renamed AND file_id % 97 <> 0 AND file_id % 5 > 2
  UNION ALL
  SELECT 'no_name' FROM items WHERE n = 1 AND file_id % 4 = 0 AND renamed AND file_id % 97 <> 0 AND file_id % 5 > 2
) r GROUP BY reason""")

oracle("text_lines", f"""
SELECT trim(line, ' ' || chr(9)) AS line, CAST(count(*) AS BIGINT) AS n FROM ({X.log_sql(D)}) l GROUP BY 1""")

oracle("convert_rows", _with(**_F) + f"""
SELECT lib, API_path, file_id, upper(scope) AS scope,
  CAST(CASE WHEN length(target_seq) > 2 THEN len(string_split(target_seq, ',')) ELSE 0 END AS BIGINT) AS n_args
FROM ({_T6_DEF} UNION ALL {_T6_MAIN}) t""")

oracle("catalog_preferred", _SIDES_SRC + f"""
SELECT lib, version, api_path,
  CASE WHEN pk % 5 = 0 THEN api_path || '{X.TEXT_ARGS}' WHEN m = 0 THEN api_path || '{X.STUB_ARGS}'
    ELSE api_path || args END AS signature
FROM s WHERE kind = 'function'""")
