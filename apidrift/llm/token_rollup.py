"""Token totals by source, language and tokenizer version, kept by deltas.

A change is one of

- ``insert``: a document with ``n_tokens`` comes in,
- ``delete``: a document with ``n_tokens`` goes out,
- ``revise``: a document's count goes from ``old_tokens`` to ``n_tokens``.

``commit`` turns the changes of one batch into signed numbers, adds them up
by key and writes the sums as one folder named by the batch.  Spark's
``_SUCCESS`` file, which is written last, is the commit mark: a batch that
has it is never applied again, one that broke off is written anew, so
replaying batches can't change the totals.  ``totals`` adds up committed
batches; ``compact`` folds them into one folder of sums and remembers which
batches it holds.

Null keys are keys of their own; null counts count as 0; changes of another
kind are refused.  Without batches the totals are empty.  Keys whose
documents all went away have totals of 0 and aren't returned.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apidrift.llm.common import texts_of
from apidrift.llm.tokens import Encoder, default_paths

KEYS = ["source", "lang", "tokenizer"]
_SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """Changes as additive rows: documents and tokens to add to each key."""
    kind = F.col("change")
    new = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))
    old = F.coalesce(F.col("old_tokens").cast("long"), F.lit(0))
    known = kind.isin("insert", "delete", "revise")
    sign = (F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0)
            .when(~F.coalesce(known, F.lit(False)), F.raise_error(F.lit("unknown kind of change"))))
    return changes.select(
        *[F.col(k).cast("string").alias(k) for k in KEYS], sign.cast("long").alias("n_docs"),
        F.when(kind == "insert", new).when(kind == "delete", -new).otherwise(new - old).alias("n_tokens"))


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class TokenRollup:
    """Totals under ``path``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _done(self, path: str) -> bool:
        fs, p = self._fs(f"{path}/_SUCCESS")
        return fs.exists(p)

    def _folders(self, kind: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{kind}")
        if not fs.exists(p):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(p))
        return [n for n in names if self._done(f"{self.path}/{kind}/{n}")]

    def _held(self) -> tuple[str | None, set[str]]:
        """The newest folder of sums and the batches in it."""
        bases = self._folders("base")
        if not bases:
            return None, set()
        rows = self.spark.read.parquet(f"{self.path}/held/{bases[-1]}").collect()
        return bases[-1], {r[0] for r in rows}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch; False if it was committed before."""
        if not batch or "/" in batch or batch[0] in "._":
            raise ValueError(f"not a batch name: {batch!r}")
        to = f"{self.path}/batch/{batch}"
        if self._done(to) or batch in self._held()[1]:
            return False
        _sums(signed(changes)).write.mode("overwrite").parquet(to)
        return True

    def totals(self) -> DataFrame:
        base, held = self._held()
        paths = [f"{self.path}/batch/{b}" for b in self._folders("batch") if b not in held]
        if base:
            paths.append(f"{self.path}/base/{base}")
        rows = (self.spark.read.schema(_SUMS).parquet(*paths) if paths
                else self.spark.createDataFrame([], _SUMS))
        return _sums(rows).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Fold committed batches into one folder of sums."""
        base, held = self._held()
        batches = held | set(self._folders("batch"))
        name = f"{int(base or -1) + 1:08d}"
        # the list of batches goes first: sums count from when they are whole
        self.spark.createDataFrame([(b,) for b in sorted(batches)], "batch string").write.mode(
            "overwrite").parquet(f"{self.path}/held/{name}")
        self.totals().write.mode("overwrite").parquet(f"{self.path}/base/{name}")


def count_tokens(docs: DataFrame, paths: tuple[str, str] | None = None, keep: list[str] = []) -> DataFrame:
    """doc_id, source, lang, the columns of ``keep`` (as long) and the token count of the whole text (null: 0)."""
    tokenizer, ranks = paths or default_paths()

    def run(batches):
        encoder = Encoder.of(tokenizer, ranks)
        for batch in batches:
            n = [len(encoder.ids(t.as_py())) // 4 for t in batch.column("text")]
            yield batch.drop_columns(["text"]).append_column("n_tokens", pa.array(n, pa.int64()))

    rows = texts_of(docs, F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                    *[F.col(c).cast("long").alias(c) for c in keep])
    kept = "".join(f", {c} long" for c in keep)
    return rows.mapInArrow(run, f"doc_id long, source string, lang string{kept}, n_tokens long")
