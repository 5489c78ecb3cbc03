"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apidrift.session import checkpoint, ship_package, table

__all__ = ["checkpoint", "table", "ship_package", "texts_of", "ROW", "packed",
           "phase", "slices", "buffers", "crc_mod", "first_seen_key", "mix64"]

ROW = "__row"


def texts_of(docs: DataFrame, *extra: str | Column) -> DataFrame:
    """``doc_id`` (as long), ``text`` (null becomes empty) and ``extra`` only.

    Selecting by name first keeps extra columns, whatever their names, away
    from the operators' own columns.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       *[F.col(c) if isinstance(c, str) else c for c in extra])


def packed(docs: DataFrame, *own: Column) -> DataFrame:
    """The whole input row as one struct column next to the ``own`` columns.

    Operators that return the columns of their input work beside this struct
    and unpack it in the end, so names of the input can't clash.
    """
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW), *own)


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo ``n`` (null: the empty text's)."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def first_seen_key(col: Column) -> Column:
    """Order key of a document id: null ids come after all others."""
    return F.coalesce(col.cast("long"), F.lit(2**63 - 1))


def phase(df: DataFrame) -> DataFrame:
    """A checkpoint that leaves no shuffle files behind.

    Spark keeps the files of a shuffle until its owner is collected as
    garbage, which in a driver with little to do may be long after the disks
    are full. While this one query runs, Spark is told to delete the query's
    own files at its end; the setting is put back right after.
    """
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = conf.get(key, None)
    conf.set(key, "true")
    try:
        # a query reads the setting when it is made: this makes it anew
        return checkpoint(df.select("*"))
    finally:
        conf.unset(key) if old is None else conf.set(key, old)


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column with about ``most`` bytes each.

    A longer row makes a range of its own.
    """
    n = len(column)
    if n == 0:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    end = np.cumsum(size)
    lo = 0
    while lo < n:
        base = end[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(end, base + most, side="right")))
        yield lo, hi
        lo = hi


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows) of a string column without nulls."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        off = np.frombuffer(column.buffers()[1], np.int64)
    else:
        off = np.frombuffer(column.buffers()[1], np.int32)
    off = off[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser over unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
