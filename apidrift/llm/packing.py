"""Best-two-fit packing of documents into token sequences of fixed length.

Fill a bin greedily with the longest pieces that fit, then put back the
bin's smallest piece and take two unpacked pieces that fill its place and
the gap more tightly; repeat that while it gains.

A first pass tokenizes each document in the task that reads it and keeps
only lengths and checksums.  Pieces as long as a sequence fill one each.
The others are dealt to as many groups as keep a group at
``group_pieces`` rows, and each group is packed alone: groups grow in
number, not in size, and each leaves at most one badly filled sequence.

Null or empty text: one piece holding only the end id.  Repeated rows are
packed as often as they occur.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apidrift.llm.common import checkpoint, texts_of
from apidrift.llm.tokens import Encoder, default_paths

SEQUENCE = 2048
END_ID = 0
GROUP_PIECES = 50_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(n: int, most: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be short of ``most``."""
    first = n % most or most
    return [(0, min(first, n))] + [(s, most) for s in range(first, n, most)]


def pieces(docs: DataFrame, most: int = SEQUENCE, paths: tuple[str, str] | None = None) -> DataFrame:
    """Pieces of every document: place in it, length and checksum of its ids."""
    tokenizer, ranks = paths or default_paths()
    end = np.asarray([END_ID], "<u4").tobytes()

    def run(batches):
        encoder = Encoder.of(tokenizer, ranks)
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), [[] for _ in range(5)]
            for doc_id, text in zip(ids, batch.column(1), strict=True):
                data = encoder.ids(text.as_py()) + end
                for k, (start, length) in enumerate(cut(len(data) // 4, most)):
                    part = data[4 * start:4 * (start + length)]
                    for out, v in zip(rows, (doc_id, k, start, length, zlib.crc32(part)), strict=True):
                        out.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()),
                 *[pa.array(r, pa.int64()) for r in rows[2:]]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts_of(docs).mapInArrow(run, _PIECES)


def best_two_fit(lengths: list[int], most: int = SEQUENCE) -> list[list[int]]:
    """Bins, as lists of positions in ``lengths``, each of ``most`` at most in total."""
    left: dict[int, list[int]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        left[lengths[i]].append(i)
    free = 0  # bit n is set while a piece of length n is unpacked
    for n in left:
        free |= 1 << n

    def take(n: int) -> int:
        nonlocal free
        i = left[n].pop()
        if not left[n]:
            free &= ~(1 << n)
        return i

    def longest(n: int) -> int:
        return (free & ((1 << (n + 1)) - 1)).bit_length() - 1 if n > 0 else -1

    bins = []
    while free:
        now: list[tuple[int, int]] = []
        gap = most
        while (n := longest(gap)) > 0:
            now.append((n, take(n)))
            gap -= n
        while gap and now:
            small, i = min(now)
            room, best = gap + small, (small, 0, 0)
            a = longest(room - 1)
            while 2 * a >= room - a and a > 0 and best[0] < room:
                b = longest(room - a)
                if b == a and len(left[a]) < 2:
                    b = longest(a - 1)
                if b > 0 and a + b > best[0]:
                    best = (a + b, a, b)
                if 2 * a <= best[0]:
                    break
                a = longest(a - 1)
            if not best[1]:
                break
            now.remove((small, i))
            now += [(n, take(n)) for n in best[1:]]
            left[small].append(i)
            free |= 1 << small
            gap = room - best[0]
        bins.append([i for _, i in now])
    return bins


def place(table: pa.Table, most: int = SEQUENCE) -> pa.Table:
    """Sequence number within the group and offset of each piece."""
    bins = best_two_fit(table.column("length").to_pylist(), most)
    length = table.column("length").to_numpy()
    seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for k, members in enumerate(bins):
        at = 0
        for i in members:
            seq[i], off[i] = k, at
            at += length[i]
    return table.append_column("local", pa.array(seq)).append_column("offset", pa.array(off))


def pack(docs: DataFrame, most: int = SEQUENCE, group_pieces: int = GROUP_PIECES,
         paths: tuple[str, str] | None = None) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    # read twice below (count, packing): the tokenizer must not run twice
    cuts = checkpoint(pieces(docs, most, paths)).withColumn("row", F.monotonically_increasing_id())
    short = cuts.where(F.col("length") < most)
    groups = max(1, -(-short.count() // group_pieces))
    # rows are dealt to groups by their own number, whatever the ids; the
    # checkpoint keeps that number the same when a task runs again
    short = short.withColumn("group", F.pmod(F.hash("row"), F.lit(groups)).cast("long"))

    def run(table: pa.Table) -> pa.Table:
        placed = place(table.sort_by([("length", "descending"), ("row", "ascending")]), most)
        group = placed.column("group").to_numpy()
        seq = pa.array(group * (1 << 32) + placed.column("local").to_numpy())
        return placed.drop_columns(["group", "row", "local"]).append_column("sequence_id", seq).select(
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = cuts.where(F.col("length") >= most).select(
        *names, (F.col("row") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return short.select(*names, "row", "group").groupBy("group").applyInArrow(run, _PLACED).unionByName(whole)
