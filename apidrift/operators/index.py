"""A stored index of the identifiers of a corpus.

The index has two tables for each set of files that was added:

- ``words``: (word, file_id), one row for each identifier of a file, in
  ``buckets`` buckets by the word;
- ``files``: the files themselves, in ``buckets`` buckets by ``file_id``.

How many buckets there are goes by the number of files, unless it is given.

A search meets the words of its queries in their buckets, takes the ids found
to the buckets of the files, and verifies the terms there.  Both tables were
dealt out when they were written, so a search shuffles queries and ids, never
words or content.  New files are added as a set of their own and old ones stay
as they are; one manifest names the sets (``sources.versions``), so a search
sees a set as a whole or not at all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apidrift.operators import retrieve
from apidrift.sources.versions import CommitConflict, VersionedTable

# A set of files has so many buckets at least, and one for so many files: a bucket's sort fits a task's memory.
BUCKETS, FILES_PER_BUCKET = 64, 50_000
WORD = r"(?U)\w+"


def identifiers(content) -> "F.Column":
    """Distinct words of a text, of which identifiers are some."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(WORD), 0))


class CorpusIndex:
    """An index under ``path``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets
        self.table = VersionedTable(spark, path)
        self._open: dict = {}

    # ------------------------------------------------------------ writing

    def add(self, files: DataFrame, tries: int = 5) -> int:
        """Add files (file_id, content and whatever goes with them); ids must be new to the index."""
        name = uuid.uuid4().hex
        n = self.buckets or max(BUCKETS, -(-files.count() // FILES_PER_BUCKET))
        words = files.select("file_id", F.explode(identifiers(F.col("content"))).alias("word"))
        self._write(words, name, "words", "word", n)
        self._write(files, name, "files", "file_id", n)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
        for left in reversed(range(tries)):
            m = self.table.manifest()
            try:
                buckets = m.note["buckets"] if m else {}
                return self.table.commit((*(m.parts if m else ()), name), schema, m.version if m else None,
                                         {"buckets": {**buckets, name: n}})
            except CommitConflict:
                if not left:
                    raise
        raise AssertionError

    def _write(self, df: DataFrame, name: str, kind: str, by: str, n: int) -> None:
        (df.repartition(n, by).write.format("parquet").option("compression", "zstd").option("path", f"{self.table.path}/data/{name}/{kind}")
         .bucketBy(n, by).sortBy(by).saveAsTable(self._name(name, kind)))
        self._open[name, kind] = True

    # ------------------------------------------------------------ reading

    def _name(self, part: str, kind: str) -> str:
        return f"apidrift_{kind}_{part}"

    def _table(self, part: str, kind: str, schema: str, buckets: int) -> DataFrame:
        """A bucketed table of a set; a session that didn't write it makes it known first."""
        name, by = self._name(part, kind), "word" if kind == "words" else "file_id"
        if (part, kind) not in self._open and not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) "
                           f"INTO {int(buckets)} BUCKETS LOCATION '{self.table.path}/data/{part}/{kind}'")
        self._open[part, kind] = True
        return self.spark.table(name)

    def sets(self) -> list[tuple[DataFrame, DataFrame, int]]:
        """(words, files, buckets) of each set of files."""
        m = self.table.manifest()
        if m is None:
            return []
        out = []
        for part in m.parts:
            n = m.note["buckets"][part]
            out.append((self._table(part, "words", "file_id bigint, word string", n),
                        self._table(part, "files", m.schema, n), n))
        return out

    def files(self) -> DataFrame:
        """All files of the index."""
        return _union([files for _, files, _ in self.sets()])

    def files_with(self, hits, together=None) -> DataFrame:
        """Files and what ``hits`` found for them.

        ``hits(words)`` maps a words table to rows with a ``file_id``; these travel
        to the buckets of the files.  An id occurs once, or its rows are put
        ``together`` there, by an aggregate.
        """
        out = []
        for words, files, n in self.sets():
            found = hits(words).repartition(n, "file_id")
            if together is not None:
                found = found.groupBy("file_id").agg(together)
            # the rows found are sorted into the buckets of the files, which stay where they are
            out.append(files.hint("merge").join(found, "file_id"))
        return _union(out)

    def search(self, qs: DataFrame, keep=()) -> DataFrame:
        """The rows of ``retrieve.search`` over the files of the index."""
        terms = retrieve.wanted(qs)

        together = F.collect_list(F.struct("api_path", "query_no", "terms")).alias("queries")
        return retrieve.verified(self.files_with(lambda words: words.join(terms, "word").drop("word"), together), keep)

    def files_of_targets(self, targets: DataFrame) -> DataFrame:
        """M5/M6: files that can hold a call of a target, with these targets.

        ``targets``: class (dotted path), method and, if given, lib.  To type a variable, a file
        must hold the last name of the class, and to call the method, its name.
        Adds ``targets``, an array of (class, method) or (class, method, lib).
        """
        own = [c for c in ("class", "method", "lib") if c in targets.columns]
        t = targets.select(*own, F.substring_index("class", ".", -1).alias("leaf")).distinct()

        def hits(words):
            by_class = words.join(t.withColumnRenamed("leaf", "word"), "word").select("file_id", *own)
            by_method = words.join(t.select(F.col("method").alias("word")).distinct(), "word", "left_semi").select(
                "file_id", F.col("word").alias("method"))
            return by_class.join(by_method, ["file_id", "method"], "left_semi")

        return self.files_with(hits, F.collect_set(F.struct(*own)).alias("targets"))


def _union(frames: list[DataFrame]) -> DataFrame:
    if not frames:
        raise FileNotFoundError("the index has no files")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
