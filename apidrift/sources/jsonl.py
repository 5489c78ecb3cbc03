"""JSON / JSON Lines / text sources and sinks.

Schemas are always given, never inferred. Outputs go to paths the caller
names (on a cluster: a shared folder); Spark's job commit replaces the
reference's temp-file-and-rename.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from apidrift.functions.text import strip

# T1 raw snippet as stored: last_updated is ISO text or 'Unknown'.
SNIPPET_SCHEMA = ("repository string, url string, last_updated string, stars bigint, "
                  "content string")
CATALOG_DOC = "map<string,struct<signature:string,doc:string>>"


# Spark lists folders in up to 10,000 tasks, one for each where there are fewer: their start takes longer than the listing.
LISTING, LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 4


@contextmanager
def few_listing_tasks(spark: SparkSession):
    """Reads that are begun meanwhile list their folders in a few tasks a core, however many there are."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(LISTING_TASKS * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


def read_folders(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``sink_by_api`` wrote, with the keys as columns; ``schema`` names those that are wanted."""
    with few_listing_tasks(spark):
        return spark.read.schema(schema).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True,
               recursive: bool = True, glob: str | None = "*.jsonl") -> DataFrame:
    """A1/A2: JSON Lines under ``path`` (recursively), explicit schema.
    ``strict`` fails on a bad line (FAILFAST)."""
    r = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    with few_listing_tasks(spark):
        return r.json(path)


def read_tolerant(spark: SparkSession, path: str, schema: str,
                  glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A3: (good rows, rejects). Lines are read as text: blank lines are
    skipped, a line that does not parse goes to the reject table with its
    source file and text."""
    r = spark.read.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    lines = r.text(path).where(strip(F.col("value")) != "").withColumn(
        "_source", F.input_file_name())
    parsed = lines.withColumn("_r", F.from_json(
        "value", schema + ", _corrupt string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad_row = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    cols = [f"_r.`{f.name}`" for f in StructType.fromDDL(schema).fields]
    good = parsed.where(~bad_row).select(*cols)
    bad = parsed.where(bad_row).select(F.col("_source").alias("source"),
                                       F.col("value").alias("line"))
    return good, bad


def api_from_path(path: Column) -> Column:
    """API path of a raw snippet file: an ``api_path=`` folder when written
    by ``write_snippets``; else the file stem with dashes read as dots
    (lossy when a name holds a dash, as in the reference layout)."""
    part = F.regexp_extract(path, r"api_path=([^/]+)/", 1)
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)\.jsonl$", 1), "-", ".")
    return F.when(part != "", F.url_decode(part)).otherwise(stem)


def read_snippets(spark: SparkSession, path: str) -> DataFrame:
    """T1 rows with api_path and a parsed timestamp ('Unknown' -> NULL)."""
    df = read_jsonl(spark, path, SNIPPET_SCHEMA, glob=None)
    return (df.withColumn("api_path", api_from_path(F.input_file_name()))
            .withColumn("last_updated_ts", F.try_to_timestamp(
                F.col("last_updated"), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> None:
    """A6."""
    df.write.mode(mode).option("compression", compression).json(path)


def sink_by_api(df: DataFrame, path: str, keys=("lib", "api_path"),
                mode: str = "append", only_keys: bool = True, compression: str = "none") -> None:
    """One folder per API, appended (or dynamically overwritten).

    ``only_keys``: overwriting replaces the folders of the keys in ``df``;
    without it, all that ``path`` holds.

    A rebalance on the keys puts each API's rows together (few files per
    folder) while AQE splits a hot API over several tasks and merges
    small ones; an API with no rows writes nothing.
    """
    w = df.hint("rebalance", *keys).write.mode(mode).option("compression", compression)
    if mode == "overwrite":
        w = w.option("partitionOverwriteMode", "dynamic" if only_keys else "static")
    w.partitionBy(*keys).json(path)


def sink_by_class(df: DataFrame, path: str) -> None:
    """One folder per library, kind and change class; a class that is written again is
    replaced as a whole, others stay."""
    sink_by_api(df, path, keys=("lib", "kind", "category"), mode="overwrite")


def write_snippets(df: DataFrame, path: str) -> None:
    """Raw snippets per API, replacing that API's folder only."""
    sink_by_api(df, path, keys=("api_path",), mode="overwrite")


def export_catalog(catalog: DataFrame, path: str) -> None:
    """One JSON object per (lib, version, kind): {api_path: {signature, doc}}.

    One document per group is the export format itself; a group is one
    library version's catalog, bounded by the library's size.
    """
    doc = F.to_json(F.map_from_entries(F.collect_list(F.struct(
        F.col("api_path"), F.struct("signature", "doc")))))
    (catalog.groupBy("lib", "version", "kind").agg(doc.alias("value"))
     .write.mode("overwrite").partitionBy("lib", "version", "kind").text(path))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A4: JSON object documents -> T2 rows."""
    df = (spark.read.schema("value string, lib string, version string, kind string")
          .option("wholetext", "true").text(path))
    m = F.from_json("value", CATALOG_DOC)
    return df.select("lib", "version", "kind", F.explode(m).alias("api_path", "e")).select(
        "lib", "version", "kind", "api_path", F.col("e.signature").alias("signature"),
        F.col("e.doc").alias("doc"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A5: stripped lines of text files."""
    return spark.read.text(path).select(strip(F.col("value")).alias("line"))


def write_lines(df: DataFrame, col: str, path: str) -> None:
    df.select(F.col(col).alias("value")).write.mode("overwrite").text(path)


def decode_content(b64: Column) -> Column:
    """base64 (line-wrapped allowed) -> UTF-8 text; '' when the bytes
    are not valid UTF-8 or the field is empty."""
    raw = F.unbase64(b64)
    return (F.when(b64.isNull() | (b64 == ""), F.lit(""))
            .when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
            .otherwise(F.lit("")))
