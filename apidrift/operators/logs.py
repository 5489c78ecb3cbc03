"""Marker logs -> flat tables (E9, E10), and a scalable forward fill.

A marker log is text in which "file" and "record" marker lines set the
context of later lines. The context is carried by a forward fill; the
fill is a two-level scan so that no log is ever held by one task:
lines are cut into fixed blocks of the order key, each block is filled
on its own (a window per block, bounded size), and the value carried
into a block comes from a small per-block table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from apidrift.functions.text import strip


# Marker line patterns of the reference log (after strip).
FILE_MARKER = r"^Processing file:\s+(.+\.jsonl)$"
RECORD_MARKER = r"^遍历到json\s+(\d+)$"
CALL_LINE = r"^第\s+(\d+)\s+行:\s+(.+)$"

BLOCK_ROWS = 1 << 16


def forward_fill(df: DataFrame, keys: list[str], order: str, value, out,
                 block: int = BLOCK_ROWS) -> DataFrame:
    """``out`` = last non-null ``value`` at or before each row (by ``order``)
    within ``keys``; ``value``/``out`` may be lists to fill several columns
    in the same pass. ``order`` must be an integer column.

    Shuffles: one aggregation to the per-block table (one row per block),
    one small window over it for the value carried into each block, and
    one window per (keys, block) over the rows; the carry table joins back
    on (keys, block).
    """
    values = [value] if isinstance(value, str) else list(value)
    outs = [out] if isinstance(out, str) else list(out)
    d = df.withColumn("_blk", F.floor(F.col(order) / F.lit(block)))
    # last non-null value of each block (max_by skips rows whose order is null)
    last_in = d.groupBy(*keys, "_blk").agg(*[
        F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.col(order))).alias(f"_last{i}")
        for i, v in enumerate(values)])
    wb = (Window.partitionBy(*keys).orderBy("_blk")
          .rowsBetween(Window.unboundedPreceding, -1))
    carry = last_in.select(*keys, "_blk", *[
        F.last(f"_last{i}", ignorenulls=True).over(wb).alias(f"_carry{i}")
        for i in range(len(values))])
    wr = (Window.partitionBy(*keys, "_blk").orderBy(order)
          .rowsBetween(Window.unboundedPreceding, 0))
    filled = d.select("*", *[F.last(v, ignorenulls=True).over(wr).alias(f"_in{i}")
                             for i, v in enumerate(values)])
    j = filled.join(carry, [*keys, "_blk"], "left")
    for i, o in enumerate(outs):
        j = j.withColumn(o, F.coalesce(f"_in{i}", f"_carry{i}"))
    return j.drop("_blk", *[f"_in{i}" for i in range(len(values))],
                  *[f"_carry{i}" for i in range(len(values))])


def _nz(c):
    return F.when(c != "", c)


def marker_log(lines: DataFrame, file_re: str = FILE_MARKER,
               record_re: str = RECORD_MARKER, call_re: str = CALL_LINE,
               block: int = BLOCK_ROWS) -> DataFrame:
    """(log_id, line_no, line) -> (log_id, file_name, api_name,
    record_no, line_no, call_text).

    A call line counts when a file marker and, after it, a record marker
    precede it, and it contains ``.api(`` where api is the last dash part
    of the file name. The record is reset by each file marker. Per
    (file, record, line number) the last call wins; files with no kept
    call give no rows (E10).
    """
    t = strip(F.col("line"))
    fname = _nz(F.regexp_extract(t, file_re, 1))
    rec = _nz(F.regexp_extract(t, record_re, 1))
    cline = _nz(F.regexp_extract(t, call_re, 1))
    ctext = _nz(F.regexp_extract(t, call_re, 2))
    d = lines.select(
        "log_id", "line_no",
        F.when(fname.isNotNull(), F.struct(F.col("line_no").alias("at"),
                                           fname.alias("name"))).alias("_file"),
        F.when(fname.isNull() & rec.isNotNull(),
               F.struct(F.col("line_no").alias("at"),
                        rec.cast("bigint").alias("no"))).alias("_rec"),
        F.when(fname.isNull() & rec.isNull() & cline.isNotNull(),
               F.struct(cline.cast("bigint").alias("no"), ctext.alias("text"))
               ).alias("_call"))
    d = forward_fill(d, ["log_id"], "line_no", ["_file", "_rec"], ["cur_file", "cur_rec"],
                     block)
    api = F.regexp_replace(F.substring_index(F.col("cur_file.name"), "-", -1),
                           r"\.jsonl", "")
    kept = d.where(
        F.col("_call").isNotNull() & F.col("cur_file").isNotNull()
        & F.col("cur_rec").isNotNull() & (F.col("cur_rec.at") > F.col("cur_file.at"))
        & (F.col("cur_rec.no") != 0)
        & (F.instr(F.col("_call.text"), F.concat(F.lit("."), api, F.lit("("))) > 0))
    return (kept.groupBy("log_id", F.col("cur_file.name").alias("file_name"),
                         F.col("cur_rec.no").alias("record_no"),
                         F.col("_call.no").alias("line_no"))
            .agg(F.max_by(F.col("_call.text"), F.col("line_no")).alias("call_text"))
            .withColumn("api_name", F.regexp_replace(
                F.substring_index("file_name", "-", -1), r"\.jsonl", "")))


def read_log(spark, path: str) -> DataFrame:
    """A5: text log files -> (log_id, line_no, line); one log per file.

    line_no comes from monotonically_increasing_id, which grows with the
    position in a file split and with the split index, so it orders the
    lines of a file without a global sort.
    """
    return (spark.read.text(path)
            .select(F.input_file_name().alias("log_id"),
                    F.monotonically_increasing_id().alias("line_no"),
                    F.col("value").alias("line")))
