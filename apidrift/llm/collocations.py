"""Phrases whose words come together more often than their parts, by direct-address tiling.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and
pieces into words at spaces and tabs.  Everything is counted per language.

Words found ``least`` times get numbers by frequency.  A pair of numbers is a
cell of a square that is cut into tiles of ``TILE`` by ``TILE`` cells: frequent
words have small numbers, so most pairs fall in few tiles.  A tile with many
pairs in a block of text is counted by address into a dense array (one
``bincount``); what falls in the other tiles is counted by sorting the
addresses.  Frequent pairs are then numbered by frequency in their turn, and a
phrase of three words is a pair of a pair's number and a word's, counted in the
same way, and so on for longer phrases.

Each task sends tables of at most ``HEAD`` entries over all languages (the most
frequent words, or pairs) to its Python worker.  If these are all there are,
phrases with other words can't be frequent and are left out; if not, such
phrases are counted as texts, first in their block of text and then in Spark.
Either way every count is exact.

Blocks of text end at the end of a piece, so one very long text is counted in
many blocks, a task holds a bounded part of it, and no phrase is cut.

Defined cases: null text counts as empty; a null language is ``und``; words
without letters count like others; repeated rows count each time.  An empty
table, or one without phrases found often enough, gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apidrift.llm.common import buffers, checkpoint, phase, slices, texts_of

LEAST = 10
LONGEST = 3
TOP = 2000
SHARE = 50
HEAD = 1 << 17  # 2 ** BITS
TILE = 256
DENSE = 1 << 13
BLOCK = 1 << 20
#: Counts that a task holds before it puts them out: cells outside dense tiles, and texts.
PENDING = 1 << 19
#: Dense tiles that a task holds, of 4 bytes a cell.
TILES = 64
#: Rows of a batch that a task puts out.
ROWS = 1 << 16
#: Bits of a number in a cell's code (language, left, right).
BITS = 17

# What ends a piece, what ends a word.
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_ENDS = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_GAP = _ENDS | np.isin(np.arange(256), np.frombuffer(b" \t", np.uint8))
_NEWLINE = 10


def blocks(column: pa.Array, size: int = BLOCK):
    """Bytes of all rows, each row closed by a line end, in blocks that end with a piece."""
    raw, off = buffers(column)
    data = _LOW[np.insert(raw, off[1:], _NEWLINE)]
    while len(data) > 2 * size:
        ends = np.flatnonzero(_ENDS[data[size:]])
        # the line end at the very end is always found
        cut = size + int(ends[0]) + 1
        yield data[:cut]
        data = data[cut:]
    yield data


def words_of(data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words of a block, and whether each is the next word of the same piece after the one before it."""
    word = ~_GAP[data]
    edge = np.diff(word.astype(np.int8), prepend=0)
    start = np.flatnonzero(edge == 1)
    if not len(start):
        return pa.array([], pa.binary()), np.zeros(0, bool)
    # a block ends with the end of a piece
    end = np.flatnonzero(edge == -1)
    size = end - start
    off = np.zeros(len(start) + 1, np.int32)
    np.cumsum(size, out=off[1:])
    text = pa.Array.from_buffers(pa.binary(), len(start),
                                 [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data[word].tobytes())])
    ends = np.flatnonzero(_ENDS[data])
    piece = np.searchsorted(ends, start)
    follows = np.zeros(len(start), bool)
    follows[1:] = piece[1:] == piece[:-1]
    return text, follows


def _by_lang(batch: pa.RecordBatch):
    """(language, blocks of its rows) for each language of each few rows of a batch."""
    for lo, hi in slices(batch.column("text"), BLOCK):
        some = batch.slice(lo, hi - lo)
        lang = some.column("lang")
        for name in pc.unique(lang).to_pylist():
            yield name, blocks(some.filter(pc.equal(lang, name)).column("text"))


class Tiles:
    """Counts of pairs of numbers per language; a pair is (i, j), both under ``head``."""

    def __init__(self, head: int = HEAD, tile: int = TILE, dense: int = DENSE, pending: int = PENDING):
        self.tile, self.least, self.pending = tile, dense, pending
        self.side = head // tile + 1
        self.dense: dict = {}
        self.sparse: dict = {}
        self.size = 0

    def add(self, lang: int, i: np.ndarray, j: np.ndarray) -> None:
        t, side = self.tile, self.side
        of = (i // t) * side + j // t
        n = np.bincount(of, minlength=side * side)
        many = np.flatnonzero(n >= self.least)
        slot = np.full(side * side, -1)
        slot[many] = np.arange(len(many))
        at = slot[of]
        inside = at >= 0
        cells = np.bincount(at[inside] * (t * t) + (i[inside] % t) * t + j[inside] % t, minlength=len(many) * t * t)
        for tile, got in zip(many, cells.reshape(len(many), t * t), strict=True):
            key = (lang, int(tile))
            if key in self.dense:
                self.dense[key] += got.astype(np.int32)
            else:
                self.dense[key] = got.astype(np.int32)
        code, n = np.unique((i[~inside] << BITS) | j[~inside], return_counts=True)
        self.sparse.setdefault(lang, []).append((code, n))
        self.size += len(code)

    def full(self) -> bool:
        return self.size >= self.pending or len(self.dense) >= TILES

    def drain(self):
        """(language, codes, counts) of all that was counted; the tiles are empty then."""
        t, side = self.tile, self.side
        for (lang, tile), cells in self.dense.items():
            at = np.flatnonzero(cells)
            code = ((tile // side * t + at // t) << BITS) | (tile % side * t + at % t)
            self.sparse.setdefault(lang, []).append((code, cells[at]))
        self.dense = {}
        pa.default_memory_pool().release_unused()
        while self.sparse:
            lang, parts = self.sparse.popitem()
            code = np.concatenate([c for c, _ in parts])
            order = np.argsort(code, kind="stable")
            code, n = code[order], np.concatenate([c for _, c in parts])[order]
            if len(code):
                first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
                yield lang, code[first], np.add.reduceat(n, first)
        self.size = 0


class Texts:
    """Counts of phrases as texts per language."""

    def __init__(self, pending: int = PENDING):
        self.parts: dict = {}
        self.size, self.pending = 0, pending

    def add(self, lang: str, phrase: pa.Array) -> None:
        if len(phrase):
            got = pc.value_counts(phrase)
            self.parts.setdefault(lang, []).append(got)
            self.size += len(got)

    def full(self) -> bool:
        return self.size >= self.pending

    def drain(self):
        for lang, parts in self.parts.items():
            t = pa.table({"p": pa.concat_arrays([x.field("values") for x in parts]),
                          "n": pa.concat_arrays([x.field("counts") for x in parts])}).group_by("p").aggregate([("n", "sum")])
            yield lang, t.column("p").combine_chunks(), t.column("n_sum").combine_chunks()
        self.parts, self.size = {}, 0


def _word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, f): occurrences of each word."""
    def run(batches):
        found = Texts()

        def out():
            for lang, p, n in found.drain():
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, len(p)), p.cast(pa.string()), n.cast(pa.int64())],
                    names=["lang", "phrase", "f"])

        for batch in batches:
            for lang, parts in _by_lang(batch):
                for data in parts:
                    found.add(lang, words_of(data)[0])
                    if found.full():
                        yield from out()
        yield from out()

    return docs.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _head(phrases: DataFrame, head: int):
    """The most frequent rows, at most ``head``, as a pandas frame in order of frequency, and whether they are all.

    A histogram of frequencies, eight steps to the doubling, tells from where on the rows fit.
    """
    step = F.floor(F.log2("f") * 8).alias("step")
    sizes = phrases.groupBy(step).agg(F.count("*").alias("n"), F.min("f").alias("f")).orderBy(F.desc("step")).collect()
    n, least = 0, None
    for r in sizes:
        n += r["n"]
        if n > head:
            break
        least = r["f"]
    rows = phrases.where(F.col("f") >= least if least is not None else F.lit(False)).toPandas()
    return rows.sort_values(["f", "lang", "phrase"], ascending=[False, True, True]), n <= head


def _words_by_lang(rows) -> dict:
    """Phrases of a frame by language, at the places of their numbers."""
    return {lang: part["phrase"].tolist() for lang, part in rows.groupby("lang", sort=False)}


def _codes(rows) -> dict:
    """For each language the sorted cells of the phrases, and their numbers."""
    out = {}
    for lang, part in rows.groupby("lang", sort=False):
        code = part["code"].to_numpy(np.int64) & ((1 << 2 * BITS) - 1)
        order = np.argsort(code)
        out[lang] = np.stack([code[order], order])
    return out


_COUNTED = "code long, lang string, phrase string, f long"


def _counter(words: dict, all_words: bool, levels: list, all_levels: list, sizes: tuple):
    """The function that counts, in a task, phrases of ``len(levels) + 2`` words.

    ``words`` holds the known words of each language at the places of their numbers.
    ``levels`` holds for each shorter length the cells of its known phrases and
    their numbers by language, ``all_levels`` whether these are all frequent ones;
    ``sizes`` are those of the tiles.
    """
    def run(batches):
        place = {lang: k for k, lang in enumerate(words)}
        tiles, texts = Tiles(*sizes), Texts(sizes[-1])

        def out():
            for k, code, n in tiles.drain():
                code, n = pa.array((k << 2 * BITS) | code), pa.array(n.astype(np.int64))
                for lo in range(0, len(code), ROWS):
                    some = code.slice(lo, ROWS)
                    none = pa.nulls(len(some), pa.string())
                    yield pa.RecordBatch.from_arrays([some, none, none, n.slice(lo, ROWS)],
                                                     names=["code", "lang", "phrase", "f"])
            for lang, p, n in texts.drain():
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(p), pa.int64()), pa.repeat(lang, len(p)), p.cast(pa.string()), n.cast(pa.int64())],
                    names=["code", "lang", "phrase", "f"])

        for batch in batches:
            for lang, parts in _by_lang(batch):
                known = words.get(lang, pa.array([], pa.binary()))
                for data in parts:
                    text, follows = words_of(data)
                    number = pc.fill_null(pc.index_in(text, known), -1).to_numpy().astype(np.int64)
                    # left: number of the phrase that starts at a word, -1 where it can't be frequent,
                    # -2 where it may be, but has no number
                    left = np.where(number >= 0, number, -1 if all_words else -2)
                    reach = np.ones(len(number), bool)
                    for step in range(1, len(levels) + 2):
                        m = len(number) - step
                        if m <= 0:
                            left = left[:0]
                            break
                        reach = reach[:m] & follows[step:]
                        a, b = left[:m], number[step:]
                        out_of_head = b < 0
                        # both phrases that are one word shorter must be possible
                        never = ~reach | (a == -1) | (left[1:m + 1] == -1) | (out_of_head & all_words)
                        named = ~never & (a >= 0) & ~out_of_head
                        if step <= len(levels):
                            left = np.full(m, -1 if all_levels[step - 1] else -2)
                            if lang in levels[step - 1]:
                                cell, numbers = levels[step - 1][lang]
                                code = (a << BITS) | b
                                at = np.minimum(np.searchsorted(cell, code), len(cell) - 1)
                                hit = named & (cell[at] == code)
                                left[hit] = numbers[at[hit]]
                            left[never] = -1
                        else:
                            if named.any():
                                tiles.add(place[lang], a[named], b[named])
                            rest = np.flatnonzero(~never & ~named)
                            if len(rest):
                                texts.add(lang, pc.binary_join_element_wise(
                                    *[text.take(pa.array(rest + k)) for k in range(step + 1)], b" "))
                    if tiles.full() or texts.full():
                        yield from out()
        yield from out()

    return run


def _spelt(counted: DataFrame, left: dict, right: dict) -> DataFrame:
    """``counted`` with the language and the text of the phrases that are given by a code."""
    sent = counted.sparkSession.sparkContext.broadcast((left, right))

    def run(batches):
        first, second = sent.value
        langs, low = list(second), (1 << BITS) - 1
        for batch in batches:
            lang, phrase = batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()
            for k, code in enumerate(batch.column("code").to_pylist()):
                if code is not None:
                    lang[k] = langs[code >> 2 * BITS]
                    phrase[k] = f"{first[lang[k]][code >> BITS & low]} {second[lang[k]][code & low]}"
            yield pa.RecordBatch.from_arrays(
                [batch.column("code"), pa.array(lang, pa.string()), pa.array(phrase, pa.string()), batch.column("f")],
                names=["code", "lang", "phrase", "f"])

    return counted.select("code", "lang", "phrase", "f").mapInArrow(run, _COUNTED)


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, head: int = HEAD, tile: int = TILE,
                  dense: int = DENSE, pending: int = PENDING) -> DataFrame:
    """(lang, size, phrase, f, n) of all phrases of up to ``longest`` words found ``least`` times.

    ``n``: all word occurrences of the language.  ``head`` is ``HEAD`` at most.
    """
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    texts = texts_of(docs, lang).select("lang", "text")
    every = phase(_word_counts(texts))
    total = every.groupBy("lang").agg(F.sum("f").alias("n"))
    out = every.where(F.col("f") >= least)
    rows, all_words = _head(out, head)
    words = names = _words_by_lang(rows)
    known = {lang: pa.array([w.encode() for w in some], pa.binary()) for lang, some in words.items()}
    out = out.select("lang", F.lit(1).alias("size"), "phrase", "f")
    levels, all_levels = [], []
    for size in range(2, longest + 1):
        sent = spark.sparkContext.broadcast((known, all_words, levels, all_levels))

        def run(batches, sent=sent):
            return _counter(*sent.value, (head, tile, dense, pending))(batches)

        counted = texts.mapInArrow(run, _COUNTED)
        if all_words and all(all_levels):
            # all that counts has a code; tasks have put their counts together, so they go straight to the shuffle
            counted = counted.select("code", "f").repartition("code").groupBy("code").agg(F.sum("f").alias("f"))
            none = F.lit(None).cast("string")
            counted = counted.select("code", none.alias("lang"), none.alias("phrase"), "f")
        else:
            # codes depend on the words alone, so all of a phrase is counted either by code or as text
            counted = counted.groupBy("code", "lang", "phrase").agg(F.sum("f").alias("f"))
        counted = phase(_spelt(counted.where(F.col("f") >= least), names, words))
        out = out.unionByName(counted.select("lang", F.lit(size).alias("size"), "phrase", "f"))
        if size < longest:
            rows, whole = _head(counted.where("code is not null"), head)
            names = _words_by_lang(rows)
            levels = [*levels, _codes(rows)]
            all_levels = [*all_levels, whole and counted.where("code is null").isEmpty()]
    return out.join(total, "lang")


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(15,0)")


def scored(counts: DataFrame, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates that no longer one takes in.

    Counts are below 10 ** 15; products are decimals of up to 38 digits.
    """
    counts = counts.where(F.col("f") >= least)
    some = counts.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), "n",
                                           F.split("phrase", " ").alias("words"))

    def joined(start, length):
        return F.array_join(F.slice("words", start, length), " ")

    cuts = some.select("lang", "phrase", "a", "n", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "words")
    cuts = cuts.select("lang", "phrase", "a", "n", "k", joined(F.lit(1), F.col("k")).alias("head"),
                       joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    part = counts.select("lang", "phrase", "f")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.withColumn("num", F.lit(1000000).cast("decimal(7,0)") * _exact("a") * _exact("a")).withColumn(
        "den", _exact("l") * _exact("r")).withColumn("score", F.expr("num div den"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(
            F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: joined(i, m))))).alias("phrase")
    taken = some.where("size > 2").select("lang", F.col("a").alias("longer"), inside)
    taken = taken.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    best = best.join(taken, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    return best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
                       F.col("cut.score").alias("score"))


def top(phrases: DataFrame, most: int = TOP) -> DataFrame:
    """The first ``most`` of each language by score, count and text, with their rank.

    Spark keeps the first ones of each task before it shuffles.
    """
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = phrases.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, most: int = TOP, share: int = SHARE, **how) -> DataFrame:
    """The collocations of each language."""
    counts = checkpoint(phrase_counts(docs, **how))
    return top(scored(counts, how.get("least", LEAST), share), most)
