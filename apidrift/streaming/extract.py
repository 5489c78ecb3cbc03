"""Incremental call-site extraction with Structured Streaming.

The reference runs its extractor in batches and appends each batch's
call sites to one file per API (A8, F11). Here new raw-snippet files
landing in a folder are a file stream; each micro-batch goes through the
same parse pass and split, and is appended per API with ``foreachBatch``.
The stream's checkpoint numbers the batches, and a replayed batch overwrites its folder;
``trigger(availableNow=True)`` processes what is there and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from apidrift.operators import callsites, retrieve
from apidrift.sources.jsonl import SNIPPET_SCHEMA, sink_by_api

META = ("repository", "url", "last_updated", "stars")


def snippet_stream(spark: SparkSession, in_dir: str, max_files: int = 1000) -> DataFrame:
    """Raw snippet JSONL files as they arrive; file_id = hash of the url."""
    s = (spark.readStream.schema(SNIPPET_SCHEMA).option("maxFilesPerTrigger", max_files)
         .option("recursiveFileLookup", "true").json(in_dir))
    return (s.withColumn("file_id", F.xxhash64("repository", "url"))
            .withColumn("last_updated", F.try_to_timestamp(
                F.col("last_updated"), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))))


def call_sites(files: DataFrame, libs) -> DataFrame:
    """T6 rows of a (streaming or static) snippet frame."""
    recs = callsites.parse_pass(retrieve.enrich(files), libs=libs, want=("fcall",),
                                keep=META)
    return callsites.t6(callsites.function_sites(recs))


def start(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, libs,
          available_now: bool = True) -> StreamingQuery:
    """Run the extractor over new files; call sites per batch, library and API.

    Each batch has a folder of its own that is replaced as a whole when the
    batch is replayed, also if the replay yields fewer APIs.
    """

    def append(batch: DataFrame, epoch: int) -> None:
        sink_by_api(batch, f"{out_dir}/epoch={epoch}", keys=("lib", "API_path"),
                    mode="overwrite", only_keys=False)

    w = (call_sites(snippet_stream(spark, in_dir), libs).writeStream
         .foreachBatch(append).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
