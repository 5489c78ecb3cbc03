"""Quality of a text by a factorisation machine.

Features are the hashed words of the text (lower case ASCII, each distinct
word once, scaled by half the root of their number), statistics of its structure
and its length, each statistic as one of ``BINS`` ranges.  The machine adds
a weight for each feature and, for each pair of features, the product of
their low-rank vectors; with the identity
``sum_{i<j} <v_i,v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2``
that takes time linear in the number of features.

Training uses a bounded sample of labelled rows (``SAMPLE``, those with the
smallest hash of the id), one text an id.  One task runs all epochs of
stochastic gradient steps over it in an order that the ids alone decide, so
the machine is the same however the data are partitioned.  It has a fixed size.
Scoring is one pass over the documents.

Defined cases: null text counts as empty, and an empty text is scored from
its structure alone; labels that are null are left out; ids labelled more
than once count once, with the least label; without labels every score is
0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apidrift.llm import wordhash
from apidrift.llm.common import ROW, buffers, crc_mod, packed, slices, texts_of

SAMPLE = 6000
WORDS = 1 << 16
BINS = 10
RANK = 8
EPOCHS = 8
THRESHOLD = 0.7
RATE = 0.1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CLASS = {name: np.isin(np.arange(256), np.frombuffer(chars, np.uint8)) for name, chars in {
    "upper": bytes(range(65, 91)), "letter": bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)),
    "digit": b"0123456789", "space": b" \t\r\n", "line": b"\n", "stop": b".,;:", "mark": b"!?",
    "symbol": b"#*$%&|<>{}[]_=+~^@/\\"}.items()}
#: Statistics, each with the edges of its ranges.
_SHARE = np.array([0.002, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.6, 0.85])
_SIZE = np.array([5, 20, 50, 100, 200, 500, 1000, 4000, 20000])
_STATS = ("upper", "digit", "space", "stop", "mark", "symbol", "distinct", "same_as_last", "new_threes",
          "chars", "words", "lines", "word_length")


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, value) of every feature of a slice of texts, by rows."""
    data, offsets = buffers(column)
    n = len(offsets) - 1
    of = {}
    for name, table in _CLASS.items():
        acc = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=acc[1:])
        of[name] = acc[offsets[1:]] - acc[offsets[:-1]]
    size = np.diff(offsets)
    low = _LOWER[data]
    start, end, row = wordhash.spans(low, offsets)
    h = wordhash.hashes(low, start, end)
    words = np.bincount(row, minlength=n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])

    def distinct(x: np.ndarray, of_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((x, of_row))
        x, of_row = x[order], of_row[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (of_row[1:] != of_row[:-1])
        return x[new], of_row[new]

    three, three_row = wordhash.shingles(h, row, n, 3)
    some_three, some_row = distinct(three, three_row)
    word, word_row = distinct(h & np.uint64(WORDS - 1), row)
    n_distinct = np.bincount(word_row, minlength=n)
    stat = {
        "upper": _share(of["upper"], of["letter"]), "digit": _share(of["digit"], size),
        "space": _share(of["space"], size), "stop": _share(of["stop"], words), "mark": _share(of["mark"], words),
        "symbol": _share(of["symbol"], size), "distinct": _share(n_distinct, words),
        "same_as_last": _share(np.bincount(row, weights=same, minlength=n), words),
        "new_threes": _share(np.bincount(some_row, minlength=n), np.bincount(three_row, minlength=n)),
        "chars": size, "words": words, "lines": of["line"] + 1, "word_length": _share(of["letter"], words),
    }
    number = np.empty((n, len(_STATS)), np.int64)
    for j, name in enumerate(_STATS):
        edges = _SIZE if name in ("chars", "words", "lines", "word_length") else _SHARE
        number[:, j] = WORDS + j * BINS + np.searchsorted(edges, stat[name], side="right")
    out_row = np.concatenate([word_row, np.repeat(np.arange(n), len(_STATS))])
    out_number = np.concatenate([word.astype(np.int64), number.ravel()])
    out_value = np.concatenate([0.5 / np.sqrt(n_distinct[word_row]), np.ones(number.size)])
    order = np.argsort(out_row, kind="stable")
    return out_row[order], out_number[order], out_value[order].astype(np.float32)


N_FEATURES = WORDS + len(_STATS) * BINS


class Machine:
    """Bias, weights and vectors; rows come as (row, number, value) sorted by row, each row not empty."""

    def __init__(self, bias: float = 0.0, seed: int = 7):
        self.bias = bias
        self.w = np.zeros(N_FEATURES, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (N_FEATURES, RANK)).astype(np.float32)

    def forward(self, row, number, value):
        at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        vx = self.v[number] * value[:, None]
        total = np.add.reduceat(vx, at, axis=0)
        pairs = 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), at))
        return self.bias + np.add.reduceat(self.w[number] * value, at) + pairs, total, vx

    def score(self, row, number, value) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(row, number, value)[0], -30, 30)))

    def epoch(self, rows: list, labels: np.ndarray, rate: float, decay: float = 1e-5, batch: int = 32) -> None:
        """One pass of gradient steps, scaled by each weight's own history."""
        gw, gv, gb = np.full(N_FEATURES, 1e-2), np.full(N_FEATURES, 1e-2), 1e-2
        for lo in range(0, len(rows), batch):
            part, y = rows[lo:lo + batch], labels[lo:lo + batch]
            row = np.repeat(np.arange(len(part)), [len(a) for a, _ in part])
            number = np.concatenate([a for a, _ in part])
            value = np.concatenate([b for _, b in part])
            z, total, vx = self.forward(row, number, value)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(part)
            gx = (g[row] * value).astype(np.float32)
            touched, back = np.unique(number, return_inverse=True)
            dw = np.bincount(back, gx) + decay * self.w[touched]
            dv = np.stack([np.bincount(back, gx * (total[row, k] - vx[:, k])) for k in range(RANK)], axis=1)
            dv += decay * self.v[touched]
            gw[touched] += dw**2
            gv[touched] += (dv**2).mean(axis=1)
            gb += g.sum()**2
            self.w[touched] -= rate * dw / np.sqrt(gw[touched])
            self.v[touched] -= rate * dv / np.sqrt(gv[touched])[:, None]
            self.bias -= rate * g.sum() / np.sqrt(gb)

    def pack(self) -> bytes:
        return np.concatenate([[self.bias], self.w, self.v.ravel()]).astype("<f8").tobytes()

    @classmethod
    def unpack(cls, data: bytes | np.ndarray) -> "Machine":
        a = np.frombuffer(data, "<f8") if isinstance(data, bytes) else data
        m = cls(float(a[0]))
        m.w, m.v = a[1:1 + N_FEATURES].astype(np.float32), a[1 + N_FEATURES:].reshape(-1, RANK).astype(np.float32)
        return m


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> Machine | None:
    """A machine for the labels, from at most ``sample`` documents; None without any."""
    label = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
             .where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))

    def train(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("doc_id")
        y = table.column("label").to_numpy().astype(np.float64)
        rows = []
        column = table.column("text").chunk(0)
        for lo, hi in slices(column):
            row, number, value = features(column.slice(lo, hi - lo))
            at = np.searchsorted(row, np.arange(hi - lo + 1))
            rows += [(number[i:j], value[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
        odds = (y.sum() + 0.5) / (len(y) - y.sum() + 0.5)
        machine = Machine(float(np.log(odds)))
        for epoch in range(epochs):
            order = np.random.default_rng(epoch).permutation(len(rows))
            machine.epoch([rows[i] for i in order], y[order], RATE)
        return pa.table({"machine": pa.array([machine.pack()], pa.binary())})

    # at most ``sample`` rows of two numbers are sent, and as many documents come back: of several rows
    # of an id the one whose text has the least hash
    rows = texts_of(docs).join(F.broadcast(label), "doc_id").groupBy("doc_id", "label").agg(
        F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("doc_id", "label", "t.text")
    got = rows.groupBy(F.lit(0).alias("all")).applyInArrow(train, "machine binary").collect()
    return Machine.unpack(got[0]["machine"]) if got else None


def score(docs: DataFrame, machine: Machine | None, keep: list[str] | None = None) -> DataFrame:
    """``docs``' columns ``keep`` (doc_id), with ``score`` and ``predicted``; ``text`` must be there."""
    keep = keep or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(machine.pack() if machine else None)
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))

    def run(batches):
        own = Machine.unpack(sent.value) if sent.value else None
        for batch in batches:
            text, rest = batch.column("__text"), batch.drop_columns(["__text"])
            for lo, hi in slices(text):
                s = own.score(*features(text.slice(lo, hi - lo))) if own else np.full(hi - lo, 0.5)
                s = s.astype(np.float64)
                yield rest.slice(lo, hi - lo).append_column("score", pa.array(s)).append_column(
                    "predicted", pa.array((s >= THRESHOLD).astype(np.int32)))

    kept = rows.drop("__text").schema
    return rows.mapInArrow(run, kept.add("score", "double").add("predicted", "integer"))


def drop_low_quality(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """``docs`` without the rows that the machine rejects."""
    if machine is None:
        return docs
    rows = packed(docs, F.col("text"))
    return score(rows, machine, [ROW]).where("predicted = 1").select(f"{ROW}.*")


def held_out():
    """Rows whose labels are never learned from."""
    return crc_mod(F.col("doc_id"), 4) == 2
