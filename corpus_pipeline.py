"""The corpus pipeline: documents in, packed token sequences out.

Each stage is one operator of ``apidrift.llm``.  A stage takes the rows its
predecessor wrote and returns a DataFrame that is written as Parquet under
``spark.checkpoint.dir`` and read again, so that a lost executor costs tasks
of one stage only.  All stages but the last return the columns of documents.

- ``quality``: the factorisation machine's rejects go.
- ``line_dedup``: lines that match an earlier line go, and documents of
  which no line stays; ``n_chars`` tells the new length.
- ``near_duplicates``: one document of each class stays.
- ``decontaminate``: documents with a benchmark item go.
- ``pack``: the pieces of what is left, with their places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from apidrift.llm import dart_minhash, decontam, line_dedup, packing, quality_fm
from apidrift.llm.common import ship_package, table
from apidrift.llm.queries import quality_machine
from apidrift.session import shared_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return quality_fm.drop_low_quality(docs, quality_machine(spark, sf_dir))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return line_dedup.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return dart_minhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_stage), ("near_duplicates", near_duplicates),
          ("decontaminate", decontaminate), ("pack", pack)]

#: The classifier, the signatures and the tokenizer are beyond SQL; tests hold
#: run() against brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, "pipeline", name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
