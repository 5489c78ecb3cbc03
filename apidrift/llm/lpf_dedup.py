"""Removal of byte strings that an earlier document has, by longest previous factors.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a
document with a smaller id.  Over all suffixes in suffix order, the previous
and the next suffix of a smaller document hold the longest previous factor
of each; it is long enough if one of them shares ``LENGTH`` bytes.  Only
that is asked, so suffixes are compared up to ``LENGTH`` bytes, and the
suffix array may be split wherever neighbours share less:

1. Suffixes with equal first ``LENGTH`` bytes have the same least hash of
   ``GRAM`` bytes within them.  Suffixes that follow each other in a text
   and share that key are one run; some six runs come on a hundred bytes.
   Spark finds the keys that occur in several documents.  A task sends one
   row for each key of a block of documents, whatever the key's frequency.
2. Runs whose key is shared go to the task of their key, with their bytes;
   equal runs of a block go once, since those of greater ids need no
   comparison.  The task sorts the suffixes of each key, looks for the
   previous and next smaller document among those that share ``LENGTH``
   bytes, and answers with a mask of the suffixes of each run.
3. A key with more than ``GROUP`` different runs isn't gathered in one task.
   Its suffixes are spread by their own hash instead, and the smallest
   document of each comes from an aggregation.
4. The masks go back to the documents, which drop what they cover.

Texts that are equal as a whole are known by their digest: those of greater
ids lose everything at once.  An id is left out of the comparison only if all
of its rows are such copies.

Defined cases: null text is empty; texts under ``LENGTH`` bytes lose
nothing; rows of one id are one document and take nothing from each other;
a null id comes after all others.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apidrift.llm import wordhash
from apidrift.llm.common import buffers, first_seen_key, mix64, phase, slices

LENGTH = 50
GRAM = 16
BLOCK_BYTES = 16 << 20
GROUP = 20_000
#: Suffixes of a run at most: one bit of a mask each.
RUN = 62
#: Suffixes of whole keys that are put in order at a time; a key of more is taken by itself.
SUFFIXES = 1 << 18
#: Bytes of text whose runs are cut out at a time.
SLICE = 1 << 18


def _sums(data: np.ndarray) -> np.ndarray:
    acc = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(wordhash._VALUE[data] * wordhash._power(wordhash._BASE, len(data))[:len(data)], out=acc[1:],
              dtype=np.uint64)
    return acc


def _span_hash(acc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inv = wordhash._power(wordhash._INV, len(acc))
    return mix64((acc[end] - acc[start]) * inv[start])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    s = 1
    while 2 * s <= width:
        values = np.minimum(values[:-s], values[s:])
        s *= 2
    return np.minimum(values[:len(values) - (width - s)], values[width - s:]) if s < width else values


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, number of suffixes, key, hash of the bytes) of each run, for many texts."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    acc = _sums(data)
    gram = mix64((acc[GRAM:] - acc[:-GRAM]) * wordhash._power(wordhash._INV, n)[:n - GRAM + 1])
    key = _least(gram, LENGTH - GRAM + 1)
    # a suffix of LENGTH bytes must end in its text; none begins in the last
    # bytes of one, so runs of neighbours never meet
    outside = np.zeros(n + 1, np.int32)
    np.add.at(outside, np.maximum(offsets[1:] - LENGTH + 1, offsets[:-1]), 1)
    np.add.at(outside, offsets[1:], -1)
    inside = np.cumsum(outside)[:len(key)] == 0
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (key[1:] != key[:-1])
    start = np.flatnonzero(new)
    if not len(start):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    last = inside & np.append(new[1:] | ~inside[1:], True)
    count = np.flatnonzero(last) - start + 1
    if count.max() > RUN:
        parts = -(-count // RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, count = np.repeat(start, parts) + nth * RUN, np.repeat(count, parts) - nth * RUN
        count = np.minimum(count, RUN)
    row = np.searchsorted(offsets, start, side="right") - 1
    return row, start, count, key[start], _span_hash(acc, start, start + count + LENGTH - 1)


def _blocks(batches, text: str):
    """The batches' rows in tables of about ``BLOCK_BYTES`` of text."""
    held, size = [], 0
    for batch in batches:
        for lo, hi in slices(batch.column(text), BLOCK_BYTES):
            part = batch.slice(lo, hi - lo)
            held.append(part)
            size += int(np.diff(buffers(part.column(text))[1]).sum())
            if size >= BLOCK_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _first_of(key: np.ndarray, ident: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs by (key, id): order, marks of a key's first pair, marks of keys with several ids."""
    order = np.lexsort((ident, key))
    k, i = key[order], ident[order]
    same = np.zeros(len(k), bool)
    same[1:] = (k[1:] == k[:-1]) & (i[1:] == i[:-1])
    order, k, i = order[~same], k[~same], i[~same]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    more = ~first
    more[:-1] |= ~first[1:]
    return order, first, more


def _keys(texts: DataFrame) -> DataFrame:
    """(part, key, id, more) of the runs: of a block, all ids of each key, those with several marked ``more``.

    ``part`` is the key for its smallest id in the block, and ``key`` is
    null. Other ids are known to share the key with that one, and their part
    is a number of their own.
    """
    def run(batches):
        for block in _blocks(batches, "text"):
            keys, ids = [], []
            for part in block:
                own = part.column("id").to_numpy()
                for lo, hi in slices(part.column("text")):
                    row, _, _, key, _ = runs(*buffers(part.column("text").slice(lo, hi - lo)))
                    keys.append(key)
                    ids.append(own[lo + row])
            key, ident = np.concatenate(keys), np.concatenate(ids)
            order, first, more = _first_of(key, ident)
            for lo in range(0, len(order), 200_000):
                to = slice(lo, lo + 200_000)
                k, i = key[order[to]], ident[order[to]]
                part = np.where(first[to], k, mix64(i.view(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.view(np.int64)), pa.array(k.view(np.int64), mask=first[to]), pa.array(i), pa.array(more[to])],
                    names=["part", "key", "id", "more"])

    return texts.mapInArrow(run, "part long, key long, id long, more boolean")


def _runs_of(texts: DataFrame) -> DataFrame:
    """Runs of shared keys: (part, id, run, count, bytes).

    Equal runs of a block come once with their bytes, for the smallest id,
    and their key is the part. Those of other ids have no bytes but a name
    (``run``) and a number of suffixes, and a part of their own.
    """
    def run(batches):
        for block in _blocks(batches, "text"):
            got = [[] for _ in range(5)]
            for batch in block:
                own, wanted = batch.column("id").to_numpy(), batch.column("keys")
                for lo, hi in slices(batch.column("text"), SLICE):
                    data, offsets = buffers(batch.column("text").slice(lo, hi - lo))
                    row, start, count, key, name = runs(data, offsets)
                    want = wanted.slice(lo, hi - lo)
                    size = np.diff(want.offsets.to_numpy())
                    mine = np.repeat(np.arange(hi - lo), size).astype(np.uint64)
                    salt = np.uint64(0x9E3779B97F4A7C15)
                    asked = np.sort(want.flatten().to_numpy().view(np.uint64) ^ mix64(mine * salt))
                    mark = key ^ mix64(row.astype(np.uint64) * salt)
                    at = np.minimum(np.searchsorted(asked, mark), max(len(asked) - 1, 0))
                    keep = np.flatnonzero(asked[at] == mark) if len(asked) else at[:0]
                    row, start, count, key, name = (x[keep] for x in (row, start, count, key, name))
                    size = count + LENGTH - 1
                    to = np.concatenate(([0], np.cumsum(size)))
                    source = np.repeat((start - to[:-1]).astype(np.int32), size)
                    source += np.arange(to[-1], dtype=np.int32)
                    text = pa.Array.from_buffers(pa.binary(), len(size), [
                        None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(data[source])])
                    for out, x in zip(got, (key, own[lo + row], name, count, text), strict=True):
                        out.append(x)
            key, ident, name, count = (np.concatenate(x) for x in got[:4])
            text = pa.concat_arrays(got[4])
            del got
            order, first, _ = _first_of(name, ident)
            for pick, some in ((order[first], True), (order[~first], False)):
                for lo in range(0, len(pick), 50_000):
                    to = pick[lo:lo + 50_000]
                    i, none = ident[to], pa.nulls(len(to), pa.int64())
                    part = key[to] if some else mix64(i.view(np.uint64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part.view(np.int64)), pa.array(i),
                         none if some else pa.array(name[to].view(np.int64)), none if some else pa.array(count[to]),
                         text.take(pa.array(to)) if some else pa.nulls(len(to), pa.binary())],
                        names=["part", "id", "run", "count", "bytes"])

    return texts.mapInArrow(run, "part long, id long, run long, count long, bytes binary")


def suffixes(data: np.ndarray, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run and start in ``data`` of each suffix of runs that begin at ``at``."""
    run = np.repeat(np.arange(len(at)), count)
    return run, np.repeat(at - (np.cumsum(count) - count), count) + np.arange(count.sum())


def previous_factors(data: np.ndarray, start: np.ndarray, ident: np.ndarray) -> np.ndarray:
    """Whether the longest previous factor of each suffix has ``LENGTH`` bytes or more.

    Suffixes are put in suffix order, up to ``LENGTH`` bytes, those that are
    equal so far by document.  Among them only the previous one can be of a
    smaller document, or stand behind one: that of the block's first.  Eight
    bytes of the suffixes are at hand at a time, the last ones first.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    places = range(0, LENGTH, 8)

    def word(at: int) -> np.ndarray:
        w = eight[start + at].view(">u8").ravel().astype(np.uint64)
        return w >> np.uint64(8 * max(at + 8 - LENGTH, 0))

    order = np.argsort(ident, kind="stable")
    for at in reversed(places):
        order = order[np.argsort(word(at)[order], kind="stable")]
    shared = np.ones(len(order), bool)  # with the suffix before it
    shared[:1] = False
    for at in places:
        w = word(at)[order]
        shared[1:] &= w[1:] == w[:-1]
    block = np.maximum.accumulate(np.where(shared, 0, np.arange(len(order))))
    long_enough = np.zeros(len(order), bool)
    long_enough[order] = ident[order] > ident[order[block]]
    return long_enough


def _named(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of runs, their names and numbers of suffixes."""
    data, offsets = buffers(column)
    name = _span_hash(_sums(data), offsets[:-1], offsets[1:])
    return data, offsets, name.view(np.int64), np.diff(offsets) - LENGTH + 1


def _masks(rows: list) -> pa.RecordBatch:
    """Answers for runs of whole keys: (id, run, mask)."""
    table = pa.Table.from_batches(rows).combine_chunks()
    ident = table.column("id").to_numpy()
    data, offsets, name, count = _named(table.column("bytes").chunk(0))
    run, start = suffixes(data, offsets[:-1], count)
    bit = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    hit = previous_factors(data, start, ident[run])
    mask = np.zeros(len(ident), np.int64)
    np.bitwise_or.at(mask, run[hit], np.left_shift(np.int64(1), bit[hit]))
    return _answer(ident[mask != 0], name[mask != 0], mask[mask != 0])


_ANSWER = "id long, run long, mask long, bytes binary"


def _answer(ident, name, mask) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ident), pa.array(name), pa.array(mask), pa.nulls(len(ident), pa.binary())],
        names=["id", "run", "mask", "bytes"])


def _compare(sorted_runs: DataFrame, group: int) -> DataFrame:
    """Masks of runs that come sorted by part; rows of parts over ``group`` runs come back without a mask."""
    def later(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [part.column("id"), part.column("run"), pa.nulls(part.num_rows, pa.int64()), part.column("bytes")],
            names=["id", "run", "mask", "bytes"])

    def suffixes_of(part: pa.RecordBatch) -> int:
        return int(np.diff(buffers(part.column("bytes"))[1]).sum()) - part.num_rows * (LENGTH - 1)

    def run(batches):
        whole, n = [], 0  # rows of keys that are known to be complete, and their suffixes
        last, size, hot = [], 0, None  # rows of the key that may go on, or its value if it has too many

        def masks(more: list):
            """Answers for complete keys, once there are enough of them."""
            nonlocal whole, n
            more = [part for part in more if part.num_rows]
            many = sum(map(suffixes_of, more))
            if whole and n + many > SUFFIXES:
                yield _masks(whole)
                whole, n = [], 0
            whole, n = whole + more, n + many

        for batch in batches:
            alone = pc.is_null(batch.column("bytes"))
            loose = batch.filter(alone)
            if loose.num_rows:
                full = np.left_shift(np.int64(1), loose.column("count").to_numpy()) - 1
                yield _answer(loose.column("id"), loose.column("run"), full)
            batch = batch.filter(pc.invert(alone))
            key = batch.column("part").to_numpy()
            if not len(key):
                continue
            edge = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
            rows = np.diff(edge)

            def take(lo: int, hi: int):
                """Rows of a key that may have begun before and may go on."""
                nonlocal last, size, hot
                part, size = batch.slice(lo, hi - lo), size + hi - lo
                if size > group:
                    yield from map(later, [*last, part])
                    hot, last = key[lo], []
                else:
                    last.append(part)

            goes_on = key[0] == hot if hot is not None else last and last[0].column("part")[0].as_py() == key[0]
            if not goes_on:
                yield from masks(last)
                last, size, hot = [], 0, None
            yield from take(0, edge[1])
            if len(rows) == 1:
                continue
            yield from masks(last)
            # the keys between begin and end here
            many = np.repeat(rows > group, rows)
            middle, many = batch.slice(edge[1], edge[-2] - edge[1]), many[edge[1]:edge[-2]]
            if many.any():
                yield later(middle.filter(pa.array(many)))
                middle = middle.filter(pa.array(~many))
            yield from masks([middle])
            last, size, hot = [], 0, None
            yield from take(edge[-2], edge[-1])
        yield from masks(last)
        if whole:
            yield _masks(whole)

    return sorted_runs.mapInArrow(run, _ANSWER)


def _compare_spread(deferred: DataFrame) -> DataFrame:
    """(id, run, mask) of runs of very frequent keys, by an aggregation over their suffixes."""
    def run(batches):
        for batch in batches:
            ident = batch.column("id").to_numpy()
            data, offsets, name, count = _named(batch.column("bytes"))
            run, start = suffixes(data, offsets[:-1], count)
            bit = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
            acc = _sums(data)
            suffix = _span_hash(acc, start, start + LENGTH)
            yield pa.RecordBatch.from_arrays(
                [pa.array(suffix.view(np.int64)), pa.array(ident[run]), pa.array(name[run]), pa.array(bit)],
                names=["suffix", "id", "run", "bit"])

    each = phase(deferred.select("id", "bytes").mapInArrow(
        run, "suffix long, id long, run long, bit long"))
    first = each.groupBy("suffix").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    hit = each.join(first, "suffix").where("first < id")
    return hit.groupBy("id", "run").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("mask"))


def _apply(rows: DataFrame) -> DataFrame:
    """Drops what the masks of each row cover; ``rows``: id, doc_id, text, runs, copies."""
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                data, offsets = buffers(part.column("text"))
                row, start, count, _, name = runs(data, offsets)
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                out = [[], [], [], []]
                masks, copies = part.column("runs"), part.column("copies")
                for r in range(hi - lo):
                    a, b = offsets[r], offsets[r + 1]
                    text = data[a:b]
                    digest = hashlib.sha256(text).hexdigest()
                    removed = spans = 0
                    if b - a >= LENGTH and copies[r].is_valid and digest in copies[r].as_py():
                        removed, spans, digest = b - a, 1, empty
                    elif masks[r].is_valid and len(masks[r]):
                        flat = masks[r].values.flatten()
                        names = flat[0].to_numpy().view(np.uint64)
                        order = np.argsort(names)
                        names, mask = names[order], flat[1].to_numpy()[order]
                        mine = name[first[r]:first[r + 1]]
                        at = np.minimum(np.searchsorted(names, mine), len(names) - 1)
                        m = np.where(names[at] == mine, mask[at], 0)
                        hit = np.flatnonzero(m)
                        if len(hit):
                            n, s = count[first[r] + hit], start[first[r] + hit] - a
                            which = np.repeat(np.arange(len(hit)), n)
                            bit = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                            on = (m[hit][which] >> bit) & 1 > 0
                            begin = s[which[on]] + bit[on]
                            delta = np.zeros(b - a + 1, np.int64)
                            np.add.at(delta, begin, 1)
                            np.add.at(delta, begin + LENGTH, -1)
                            gone = np.cumsum(delta[:-1]) > 0
                            removed = int(gone.sum())
                            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                            digest = hashlib.sha256(text[~gone]).hexdigest()
                    for o, x in zip(out, (b - a, removed, spans, digest), strict=True):
                        o.append(x)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.string())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _copies(texts: DataFrame) -> DataFrame:
    """(id, digest, n) of texts that a smaller id has as a whole, with the number of such rows."""
    digest = texts.select("id", F.sha2("text", 256).alias("digest"))
    first = digest.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    return phase(digest.join(first.where("first < last"), "digest").where("first < id")
                      .groupBy("id", "digest").agg(F.count("*").alias("n")))


def _copied(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """(id): documents all of whose rows are copies; an id may have other texts besides."""
    n = F.count("*").alias("n")
    return copies.groupBy("id").agg(F.sum("n").alias("n")).join(rows.groupBy("id").agg(n), ["id", "n"]).select("id")


def _asked(texts: DataFrame, copied: DataFrame) -> DataFrame:
    """(id, keys): the keys that a document shares with others."""
    across = Window.partitionBy("part")
    shared = (_keys(texts).withColumn("lo", F.min("id").over(across)).withColumn("hi", F.max("id").over(across))
              .where("more or lo < hi").select("id", F.coalesce("key", "part").alias("key")))
    shared = shared.join(copied, "id", "left_anti")
    return phase(shared.groupBy("id").agg(F.collect_set("key").alias("keys")))


def _answers(texts: DataFrame, asked: DataFrame, group: int) -> DataFrame:
    found = _runs_of(texts.join(asked.hint("shuffle_hash"), "id").select("id", "text", "keys"))
    return phase(_compare(found.repartition("part").sortWithinPartitions("part"), group))


def dedup(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row.

    ``group``: keys with more different runs are compared by an aggregation.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(first_seen_key(F.col("doc_id")).alias("id"), F.col("doc_id").cast("long").alias("doc_id"),
                       text.cast("binary").alias("text"))
    texts = rows.select("id", "text").where(F.octet_length("text") >= LENGTH)

    copies = _copies(texts)
    asked = _asked(texts, _copied(rows, copies))
    answers = _answers(texts, asked, group)
    masks = answers.where("mask is not null").select("id", "run", "mask")
    deferred = answers.where("mask is null")
    if not deferred.isEmpty():
        masks = masks.unionByName(_compare_spread(deferred))
    masks = masks.groupBy("id", "run").agg(F.bit_or("mask").alias("mask"))

    per_run = masks.groupBy("id").agg(F.collect_list(F.struct("run", "mask")).alias("runs"))
    per_copy = copies.groupBy("id").agg(F.collect_list("digest").alias("copies"))
    info = per_run.join(per_copy, "id", "full")
    return _apply(rows.join(info.hint("shuffle_hash"), "id", "left"))
