"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "apidrift",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the jobs assume.

    On a cluster ``master`` stays None and the launcher's settings win;
    tests and the bench pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         # source files are large rows: keep Arrow batches small
         .config("spark.sql.execution.arrow.maxRecordsPerBatch", "512"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``apidrift`` importable in the executors' Python workers.

    Python UDFs and map functions are pickled by module reference, so the
    workers import this package. The package is zipped once per
    SparkContext into the shared folder (a driver temp file when that
    folder is not a local path) and handed to ``addPyFile``, which ships it
    to every executor.
    """
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_apidrift_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    base = ensure_checkpoint_dir(spark)
    local = base[len("file:"):] if base.startswith("file:") else base
    if "://" in local:
        local = tempfile.mkdtemp(prefix="apidrift-pyfiles-")
    os.makedirs(os.path.join(local, "apidrift-pyfiles"), exist_ok=True)
    path = os.path.join(local, "apidrift-pyfiles", f"apidrift-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("apidrift", os.path.relpath(full, pkg)))
    sc.addPyFile(path)
    sc._apidrift_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    On a cluster the launcher names a shared folder; it is only set here
    when nothing is configured (local runs and tests).
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not re.match(r"local(\[[^\]]*\])?$", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all nodes of {master} share")
        d = tempfile.mkdtemp(prefix="apidrift-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def checkpoint(df: DataFrame) -> DataFrame:
    """Eager, reliable checkpoint into the shared checkpoint folder.

    Cuts lineage so that an expensive upstream (a Python pass, a corpus
    scan) is neither recomputed by a second consumer nor re-run when an
    executor is lost.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read from there.

    For rows with much text that are read more than once: smaller than a
    checkpoint, and columns that are not asked for are not read.
    """
    path = shared_path(df.sparkSession, "stored")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A fresh path under the shared checkpoint folder (never machine-local)."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, "apidrift", *parts, uuid.uuid4().hex)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Driver table ``name`` under ``sf_dir`` (one parquet file each)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
