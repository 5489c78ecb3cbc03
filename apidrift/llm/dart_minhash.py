"""Near-duplicate documents by DartMinHash signatures.

A document is the weighted set of its five-word shingles (lower case,
letters and digits; the weight is the count).  Every unit of weight of an
element is a cell of the plane (weight, rank) over which hashed darts are
thrown: the ranks of a cell's darts are the arrivals of a Poisson process
drawn from the cell's hash, the same for every document that has the cell.
Darts below a rank that gives k log k + 3k of them on average are dealt to k
coordinates by hash; the earliest in each coordinate is the signature.  A
document with an empty coordinate takes darts up to twice that rank.  Two
documents agree in a coordinate with probability equal to their weighted
Jaccard similarity, and the cost hardly depends on their length.

Signatures are cut into bands and joined by band.  Texts whose words are
equal are one node from the start.  In each band bucket every node is
compared with one, that which meets most nodes in its buckets; where a bucket
still holds nodes of several classes, an exact join of its nodes' rarest
shingles (prefix, positional and length filters) finds the pairs of different
classes that may be similar.  So a bucket of copies costs one comparison
each, and no pair that shares a band goes unjudged unless its class is
already known.
A pair is linked if its exact weighted Jaccard similarity is 0.8 or more;
classes are the connected components.

Defined cases: a text with fewer than five words has one shingle of all its
words; one without words (null, empty) is a class of its own; repeated rows
are copies; a null ``doc_id`` comes after all others in choosing the kept
document.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apidrift.llm import wordhash
from apidrift.llm.common import ROW, buffers, first_seen_key, mix64, packed, phase, slices, texts_of
from apidrift.llm.graph import components

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 6
#: Hash buckets in which cells are counted, and buckets to a row of counts.
BUCKETS, CHUNK = 1 << 16, 1 << 10

_STEP = np.uint64(0x9E3779B97F4A7C15)
_DEAL = np.uint64(0xC2B2AE3D27D4EB4F)


def _times(n: int, constant: np.uint64) -> np.uint64:
    return np.uint64(n * int(constant) % 2**64)


def cells(elements: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A cell for each unit of weight: (hash, row), sorted by row and hash."""
    order = np.lexsort((elements, row))
    e, r = elements[order], row[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (r[1:] != r[:-1])
    at = np.arange(len(e))
    nth = at - np.maximum.accumulate(np.where(new, at, 0)) if len(e) else at
    c = mix64(e + nth.astype(np.uint64) * _STEP)
    order = np.lexsort((c, r))
    return c[order], r[order]


def signatures(cell: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """Least rank in each of ``k`` coordinates, for each row (infinite for rows without cells)."""
    sig = np.full(n_rows * k, np.inf)
    weight = np.bincount(row, minlength=n_rows)
    top = (k * np.log(k) + 3 * k) / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        pick = todo[row]
        c, r = cell[pick], row[pick]
        rank = np.zeros(len(c))
        step = 0
        while len(c):
            step += 1
            u = ((mix64(c + _times(step, _STEP)) >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
            inside = u >= np.exp(rank - top[r])
            c, r, rank = c[inside], r[inside], rank[inside] - np.log(u[inside])
            slot = mix64(c + _times(step, _DEAL)) % np.uint64(k)
            np.minimum.at(sig, r * k + slot.astype(np.int64), rank)
        todo &= np.isinf(sig.reshape(n_rows, k)).any(axis=1)
        top = np.where(todo, 2 * top, top)
    return sig.reshape(n_rows, k)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; ranks count in single precision, so the last bits don't matter."""
    v = sig.astype(np.float32).view(np.uint32).reshape(len(sig), bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _DEAL, (len(sig), bands)).copy()
    for i in range(rows):
        h = mix64(h * _STEP + v[:, :, i])
    return h.view(np.int64)


def _content(words: np.ndarray, row: np.ndarray, n_rows: int) -> list[bytes]:
    """A 16-byte digest of the words of each row in their order."""
    first = np.searchsorted(row, np.arange(n_rows + 1))
    pos = (np.arange(len(words)) - first[row]).astype(np.uint64) if len(words) else words
    total = np.zeros((2, len(words) + 1), np.uint64)
    np.cumsum(mix64(words + pos * _STEP), out=total[0, 1:], dtype=np.uint64)
    np.cumsum(mix64((words ^ _DEAL) + pos * _DEAL), out=total[1, 1:], dtype=np.uint64)
    both = total[:, first[1:]] - total[:, first[:-1]]
    return [a.tobytes() + b.tobytes() for a, b in both.T]


def _rows(batches, width: int):
    """For each slice of rows: its ids and text hashes, texts' digests, cells and their rows."""
    for batch in batches:
        for lo, hi in slices(batch.column("text")):
            data, offsets = buffers(batch.column("text").slice(lo, hi - lo))
            start, end, row = wordhash.spans(data, offsets)
            words = wordhash.hashes(data, start, end)
            c, r = cells(*wordhash.shingles(words, row, hi - lo, width))
            yield batch.select([0, 1]).slice(lo, hi - lo), _content(words, row, hi - lo), c, r, hi - lo


def _sign(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    def run(batches):
        for ids, content, c, r, n in _rows(batches, width):
            keys = band_keys(signatures(c, r, n, bands * rows), bands, rows)
            has = np.bincount(r, minlength=n) > 0
            off = np.concatenate(([0], np.cumsum(np.where(has, bands, 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*ids.columns, pa.array(content, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(off), pa.array(keys[has].ravel()))],
                names=["id", "text_hash", "content", "bands"])

    return docs.mapInArrow(run, "id long, text_hash long, content binary, bands array<long>")


def _elements(docs: DataFrame, width: int) -> DataFrame:
    """(content, cells): the sorted cells of each document as bytes."""
    def run(batches):
        for _, content, c, r, n in _rows(batches, width):
            at = np.searchsorted(r, np.arange(n + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(content, pa.binary()),
                 pa.array([c[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                names=["content", "cells"])

    return docs.mapInArrow(run, "content binary, cells binary")


def _cells_of(batches):
    """For each slice of rows with ``cells``: the slice, its cells and their rows, and the number of each row's."""
    for batch in batches:
        for lo, hi in slices(batch.column("cells")):
            part = batch.slice(lo, hi - lo)
            data, offsets = buffers(part.column("cells"))
            n = np.diff(offsets) // 8
            yield part, np.frombuffer(data.tobytes(), np.uint64), np.repeat(np.arange(hi - lo), n), n


def _frequency(nodes: DataFrame) -> np.ndarray:
    """How many of the nodes' cells are in each of ``BUCKETS`` hash buckets, a table of fixed size."""
    def run(batches):
        count = np.zeros(BUCKETS, np.int64)
        for _, cell, _, _ in _cells_of(batches):
            count += np.bincount((cell % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        chunks = [(i, c.tobytes()) for i, c in enumerate(count.reshape(-1, CHUNK)) if c.any()]
        if chunks:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in chunks], pa.int32()),
                                              pa.array([c for _, c in chunks], pa.binary())], names=["chunk", "counts"])

    def add(part: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(c, np.int64) for c in part.column("counts").to_pylist()], axis=0)
        return pa.table({"chunk": part.column("chunk").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "chunk int, counts binary"
    found = nodes.select("cells").mapInArrow(run, kind).groupBy("chunk").applyInArrow(add, kind)
    out = np.zeros((BUCKETS // CHUNK, CHUNK), np.int64)
    for r in found.collect():  # BUCKETS / CHUNK rows at most
        out[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    return out.ravel()


def _prefixes(nodes: DataFrame, least: float) -> DataFrame:
    """(cell, content, root, n, at): the rarest cells of each node, as many as a similar node shares one of.

    Rarity is told by counts in hash buckets (any common order is exact), so
    that only these cells leave a node, less those that no other node can have.
    """
    count = _frequency(nodes)

    def run(batches):
        for part, cell, row, n in _cells_of(batches):
            rare = count[(cell % np.uint64(BUCKETS)).astype(np.int64)]
            order = np.lexsort((cell, rare, row))
            cell, rare, row = cell[order], rare[order], row[order]
            at = np.arange(len(row)) - (np.cumsum(n) - n)[row] + 1
            prefix = n - np.ceil(n * least - 1e-9).astype(np.int64) + 1
            keep = np.flatnonzero((at <= prefix[row]) & (rare > 1))
            mine = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell[keep].view(np.int64)), part.column("content").take(mine), part.column("root").take(mine),
                 pa.array(n[row[keep]]), pa.array(at[keep])], names=["cell", "content", "root", "n", "at"])

    return nodes.select("content", "root", "cells").mapInArrow(
        run, "cell long, content binary, root binary, n long, at long")


def _candidates(nodes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different classes that may be similar, by prefix, positional and length filters.

    nodes: content, root (its class so far) and cells.  With each node's
    cells ordered by rarity, similar nodes share one within their first
    ``n - least * n + 1``, and behind it there must be room for what they
    have to share.
    """
    prefix = _prefixes(nodes, least)
    x, y = prefix.alias("x"), prefix.alias("y")
    room = 1 + F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    shared = (F.col("x.n") + F.col("y.n")) * (least / (1 + least)) - 1e-9
    met = (F.col("x.cell") == F.col("y.cell")) & (F.col("x.content") > F.col("y.content")) & (
        F.col("x.root") != F.col("y.root")) & (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * least - 1e-9) & (
        room >= shared)
    return x.join(y, met).select(F.col("x.content").alias("a"), F.col("y.content").alias("b")).distinct()


def _similar(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose cells ``x`` and ``y`` have a Jaccard similarity of ``least`` or more."""
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                n = len(x) + len(y)
                # more can't be shared than the smaller has
                if min(len(x), len(y)) < least * max(len(x), len(y)):
                    keep.append(False)
                    continue
                shared = n - len(np.union1d(x, y))
                keep.append(shared >= least * (n - shared) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _keyed(docs: DataFrame) -> DataFrame:
    """Order key of the id, hash of the text and lower-cased text of each row."""
    return texts_of(docs).select(first_seen_key(F.col("doc_id")).alias("id"),
                                 F.xxhash64("text").alias("text_hash"), F.lower("text").alias("text"))


def classes(docs: DataFrame, width: int = WIDTH, least: float = SIMILARITY,
            bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, text_hash, class_id, kept): one row for each row of ``docs``.

    ``id`` is the ``doc_id`` (the largest long for null); with the hash of
    the text it tells rows apart that share an id.  ``class_id`` is the
    smallest id of the class, ``kept`` marks its document.
    """
    texts = _keyed(docs)
    sig = phase(_sign(texts, width, bands, rows))
    nodes = phase(sig.groupBy("content").agg(F.min(F.struct("id", "text_hash")).alias("first"),
                                                  F.min("bands").alias("bands")))
    member = nodes.select("content", F.explode("bands").alias("band"))
    size = member.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    member = phase(member.join(size, "band"))
    # the source of a group of copies is nearer to each copy than they are to
    # one another, so it meets more nodes in its buckets than they do
    met = member.groupBy("content").agg(F.sum("n").alias("met"))
    rep = (member.join(met, "content").groupBy("band").agg(F.max(F.struct("met", "content")).alias("rep"))
           .select("band", F.col("rep.content").alias("rep")))
    member = phase(member.join(rep, "band"))

    pairs = phase(member.where("content <> rep")
                       .select(F.col("content").alias("a"), F.col("rep").alias("b")).distinct())
    needed = (pairs.select(F.col("a").alias("content")).unionByName(pairs.select(F.col("b").alias("content")))
              .distinct().join(nodes, "content").select("content", "first.id", "first.text_hash"))
    shingled = _elements(texts.join(needed, ["id", "text_hash"], "left_semi"), width)
    shingled = phase(shingled.join(needed.select("content"), "content", "left_semi").dropDuplicates(["content"]))

    def linked(some: DataFrame) -> DataFrame:
        with_x = some.join(shingled.select(F.col("content").alias("a"), F.col("cells").alias("x")), "a")
        with_y = with_x.join(shingled.select(F.col("content").alias("b"), F.col("cells").alias("y")), "b")
        return _similar(with_y, least)

    links = phase(linked(pairs))
    root = components(links, "a", "b")

    # what the comparison with one node of each bucket leaves open
    more = member.where("n > 2").join(root.withColumnRenamed("node", "content"), "content", "left")
    more = more.select("band", "content", F.coalesce("root", "content").alias("root"))
    open_bands = (more.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
                  .where("lo <> hi").select("band"))
    more = phase(more.join(open_bands, "band").select("content", "root").distinct())
    rest = phase(_candidates(more.join(shingled, "content"), least))
    second = phase(linked(rest))
    if not second.isEmpty():
        root = components(links.unionByName(second), "a", "b")

    label = nodes.select("content", "first").join(root.withColumnRenamed("node", "content"), "content", "left")
    label = label.select("content", "first", F.coalesce("root", "content").alias("root"))
    head = label.groupBy("root").agg(F.min("first").alias("head"))
    label = label.join(head, "root").select("content", "head")
    # texts without words are no copies of one another
    own = F.struct("id", "text_hash")
    return (sig.withColumn("worded", F.size("bands") > 0).join(label, "content")
            .withColumn("head", F.when(F.col("worded"), F.col("head")).otherwise(own))
            .select("id", "text_hash", F.col("head.id").alias("class_id"), (F.col("head") == own).alias("kept")))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each class: that of the smallest id, once if its row is repeated."""
    kept = classes(docs, **how).where("kept").select("id", "text_hash").distinct()
    own = [first_seen_key(F.col("doc_id")).alias("id"),
           F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash")]
    rows = packed(docs, *own).join(kept, ["id", "text_hash"], "left_semi")
    again = F.row_number().over(Window.partitionBy("id", "text_hash").orderBy(F.lit(1)))
    return rows.withColumn("nth", again).where("nth = 1").select(f"{ROW}.*")
