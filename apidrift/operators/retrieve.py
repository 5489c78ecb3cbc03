"""Retrieval of candidate files for changed APIs over a corpus table.

The reference sends conjunctive phrase queries to a web code search. Here
the same queries run over a corpus DataFrame:

* every query holds a leaf word (the last name of the search path; for a
  method, its class), so each file's distinct identifiers are exploded and joined to
  the small query table on that word - no
  files x queries product, and content is never shuffled;
* surviving (file, query) pairs are verified term by term with a bounded
  match (no word character next to an end that is itself a word char): the
  content's word boundaries are marked in one pass, terms are then substrings;
* the hit budget, counts and top-m per API are windows over the small
  (api, query) and (api, query, file) tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Hit budget per API, results per page, usable files per API.
BUDGET = 500
PAGE_SIZE = 100
TOP_M = 5


def _join(parts: Column, start, length) -> Column:
    return F.array_join(F.slice(parts, start, length), ".")


def api_key(api_path: Column, kind: Column) -> tuple[Column, Column]:
    """(search path, tail): methods split at the last dot; functions
    have no tail; a trailing ``.__init__`` is removed."""
    p = F.regexp_replace(api_path, r"\.__init__$", "")
    tail = F.when(kind == "method", F.substring_index(p, ".", -1))
    head = F.when(kind == "method", F.regexp_replace(p, r"\.[^.]*$", "")).otherwise(p)
    return head, tail


def patterns(path: Column) -> Column:
    """Direct path, then per split point i: ``import P as``, ``.rest``,
    ``from P import x``, ``.rest-after-x`` or ``x`` (1 + 4(n-1) strings)."""
    parts = F.split(path, r"\.", -1)
    k = F.size(parts)
    per = F.transform(F.sequence(F.lit(1), F.greatest(k - 1, F.lit(1))), lambda i: F.array(
        F.concat(F.lit("import "), _join(parts, 1, i), F.lit(" as")),
        F.concat(F.lit("."), _join(parts, i + 1, k - i)),
        F.concat(F.lit("from "), _join(parts, 1, i), F.lit(" import "),
                 F.get(parts, i)),
        F.when(i + 1 < k, F.concat(F.lit("."), _join(parts, i + 2, k - i - 1)))
         .otherwise(F.get(parts, i))))
    return F.concat(F.array(path), F.when(k > 1, F.flatten(per)).otherwise(
        F.array().cast("array<string>")))


def queries(apis: DataFrame) -> DataFrame:
    """R2: ordered conjunctive queries per API.

    ``apis`` has api_path and kind. Query 1 is the direct path, then one
    per import-as pair, then one per from-import pair; methods add the
    ``.tail`` term to each. Output: api_path, kind, query_no, terms, leaf.
    """
    head, tail = api_key(F.col("api_path"), F.col("kind"))
    a = apis.select("api_path", "kind", head.alias("_head"), tail.alias("_tail"))
    pats = patterns(F.col("_head"))
    k = F.size(F.split("_head", r"\.", -1))
    n_pairs = k - 1
    extra = F.when(F.col("_tail").isNotNull(),
                   F.array(F.concat(F.lit("."), F.col("_tail")))).otherwise(
        F.array().cast("array<string>"))
    seq = F.sequence(F.lit(0), F.greatest(n_pairs - 1, F.lit(0)))
    imp = F.transform(seq, lambda j: F.struct(
        (j + 2).alias("query_no"),
        F.array(F.get(pats, j * 4 + 1), F.get(pats, j * 4 + 2)).alias("terms")))
    frm = F.transform(seq, lambda j: F.struct(
        (n_pairs + j + 2).alias("query_no"),
        F.array(F.get(pats, j * 4 + 3), F.get(pats, j * 4 + 4)).alias("terms")))
    direct = F.array(F.struct(F.lit(1).alias("query_no"),
                              F.array(F.col("_head")).alias("terms")))
    allq = F.when(n_pairs > 0, F.concat(direct, imp, frm)).otherwise(direct)
    q = a.select("api_path", "kind", "_head", "_tail", F.explode(allq).alias("q"))
    # every query holds the last name of the search path as a bounded
    # token (for methods: the class, far rarer than the method name)
    leaf = F.substring_index(F.col("_head"), ".", -1)
    return q.select("api_path", "kind", F.col("q.query_no").alias("query_no"),
                    F.concat(F.col("q.terms"), extra).alias("terms"),
                    leaf.alias("leaf"))


# Stands for a word boundary; what a text holds of it makes way for another
# character that is no part of a word either.
EDGE, OTHER = "\x01", "\x02"


def edged(text: Column) -> Column:
    """``text`` with a mark at each word boundary.

    A term occurs bounded (no word character next to an end that is itself
    one) exactly where its marked form occurs in the marked text, so one pass
    over a text with a fixed pattern serves all terms, by plain substring tests.
    """
    return F.regexp_replace(F.translate(text, EDGE, OTHER), r"(?U)\b", EDGE)


def wanted(qs: DataFrame) -> DataFrame:
    """The queries with marked terms, by their leaf word."""
    return qs.select("api_path", "query_no", F.transform("terms", edged).alias("terms"), F.col("leaf").alias("word"))


def search(corpus: DataFrame, qs: DataFrame, keep=()) -> DataFrame:
    """(api_path, query_no, file_id, *keep) for every file holding all
    terms of a query.

    Union over queries without dedup: a file found by two queries of one
    API appears twice. Files are never compared with every query: only
    pairs that share the leaf word are checked. The words of a file travel
    with its id alone; the queries found for a file are put together and
    meet its content once. ``keep`` (e.g. content, for the usage test) is only
    copied for matching pairs. No step needs a broadcast.
    """
    extra = [c for c in keep if c not in ("file_id", "content")]
    words = corpus.select("file_id", F.explode(F.array_distinct(F.regexp_extract_all(
        "content", F.lit(r"(?U)\w+"), 0))).alias("word"))
    cand = words.join(wanted(qs), "word")
    per_file = cand.groupBy("file_id").agg(
        F.collect_list(F.struct("api_path", "query_no", "terms")).alias("queries"))
    return verified(corpus.select("file_id", "content", *extra).join(per_file, "file_id"), keep)


def verified(candidates: DataFrame, keep=()) -> DataFrame:
    """(api_path, query_no, file_id, *keep) for the ``queries`` of each file whose terms its content holds."""
    hit = F.filter("queries", lambda q: F.forall(q["terms"], lambda t: F.col("_edged").contains(t)))
    found = candidates.withColumn("_edged", edged(F.col("content"))).select(
        "file_id", *[c for c in keep if c != "file_id"], F.explode(hit).alias("q"))
    return found.select("q.api_path", "q.query_no", "file_id", *keep)


def distinct_files(found: DataFrame, facts: DataFrame) -> DataFrame:
    """Found files with their ids put together by (repository, url).

    ``found`` has a ``file_id``; files of one repository and url are one file,
    that of the smallest id among those found (others of the corpus don't
    count).  Files without a url are files of their own.  ``facts`` has file_id,
    repository and url; only ids and names are shuffled.
    """
    name = F.coalesce("url", F.concat(F.lit("#"), F.col("file_id").cast("string")))
    ids = found.select("file_id").distinct().join(facts.select("file_id", "repository", "url"), "file_id")
    first = Window.partitionBy("repository", name)
    one = ids.select("file_id", F.min("file_id").over(first).alias("_first"))
    return (found.join(one, "file_id").drop("file_id").withColumnRenamed("_first", "file_id")
            .select(*found.columns).distinct())


def query_totals(qs: DataFrame, matches: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Hits per query and whether the query runs under the budget.

    A query runs while the hits of the queries before it stay within the
    budget (the query that crosses it is kept).
    """
    tot = matches.groupBy("api_path", "query_no").agg(F.count(F.lit(1)).alias("n_hits"))
    t = qs.select("api_path", "query_no").join(tot, ["api_path", "query_no"], "left")
    t = t.withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    w = (Window.partitionBy("api_path").orderBy("query_no")
         .rowsBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(F.sum("n_hits").over(w), F.lit(0))
    return t.withColumn("kept", before <= budget)


def hit_counts(totals: DataFrame) -> DataFrame:
    """Hits per API over the queries that ran (counted once)."""
    return totals.where("kept").groupBy("api_path").agg(
        F.sum("n_hits").alias("n_hits"))


def top_m(matches: DataFrame, totals: DataFrame, m: int = TOP_M,
          page_size: int = PAGE_SIZE) -> DataFrame:
    """First m usable files per API in (page, query, place) order.

    Place within a query is file_id. Only the first m of each query can
    be among the first m overall, so a per-(api, query) limit runs first
    (partial top-k before the shuffle; a hot API costs m rows per task).
    Every match holds its terms, so its content is non-empty (usable, R7).
    """
    runs = totals.where("kept").select("api_path", "query_no")
    mm = matches.join(runs, ["api_path", "query_no"], "left_semi")
    w1 = Window.partitionBy("api_path", "query_no").orderBy("file_id")
    mm = mm.withColumn("place", F.row_number().over(w1)).where(F.col("place") <= m)
    mm = mm.withColumn("page", F.ceil(F.col("place") / page_size))
    w2 = Window.partitionBy("api_path").orderBy("page", "query_no", "place")
    return mm.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= m)


def enrich(corpus: DataFrame) -> DataFrame:
    """Stars default 0; unknown update time stays NULL ('Unknown');
    files without content are dropped."""
    return (corpus.where(F.length("content") > 0)
            .withColumn("stars", F.coalesce(F.col("stars"), F.lit(0).cast("bigint"))))


def filter_files(df: DataFrame, stars_limit=None, time_limit=None) -> DataFrame:
    """Drop stars < limit; drop files updated after time_limit (an
    unknown time passes). A None limit is off."""
    out = df
    if stars_limit is not None:
        out = out.where(F.col("stars") >= F.lit(stars_limit))
    if time_limit is not None:
        out = out.where(F.col("last_updated").isNull()
                        | (F.col("last_updated") <= F.to_timestamp(F.lit(time_limit))))
    return out


def _between_edges(text: Column) -> Column:
    """Marked form of a text that has a word boundary at both ends."""
    inner = edged(text)
    return F.concat(F.when(inner.startswith(EDGE), F.lit("")).otherwise(F.lit(EDGE)), inner,
                    F.when(inner.endswith(EDGE), F.lit("")).otherwise(F.lit(EDGE)))


def usage_test(pairs: DataFrame) -> DataFrame:
    """R9 on (api_path, content) rows: does the file use the API?

    True on a direct hit; or a from-import together with its own usage
    term; or an ``import P as A`` line together with ``A.rest``.  All
    patterns are fixed: the content's boundaries are marked once, its ``import as``
    lines are taken out once, and terms are then plain substrings.
    """
    parts = F.split("api_path", r"\.", -1)
    k = F.size(parts)
    seq = F.sequence(F.lit(1), F.greatest(k - 1, F.lit(1)))
    text = F.col("_edged")

    def holds(term):
        return text.contains(_between_edges(term))

    lines = F.lit(r"(?mU)^import\s+(\S+)\s+as\s+(\w+)")
    named = F.arrays_zip(F.regexp_extract_all("content", lines, 1).alias("path"),
                         F.regexp_extract_all("content", lines, 2).alias("name"))
    direct = holds(F.col("api_path"))
    frm = F.exists(seq, lambda i: (k > 1) & holds(F.concat(
        F.lit("from "), _join(parts, 1, i), F.lit(" import "), F.get(parts, i)))
        & holds(F.when(i + 1 < k, F.concat(F.lit("."), _join(parts, i + 2, k - i - 1))).otherwise(F.get(parts, i))))
    imp = F.exists(seq, lambda i: (k > 1) & F.exists("_named", lambda a: (a["path"] == _join(parts, 1, i)) & holds(
        F.concat(a["name"], F.lit("."), _join(parts, i + 1, k - i)))))
    marked = pairs.withColumn("_edged", edged(F.col("content"))).withColumn("_named", named)
    return marked.withColumn("used", direct | frm | imp).drop("_edged", "_named")
