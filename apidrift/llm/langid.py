"""Language of a text by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public
vocabulary.  The probability of a word is the sum, over all ways to cut it
into pieces, of the product of their probabilities; a forward pass over the
word's characters gives it.  A text's score for a language is the sum of the
logarithms over its words, and the answer is the language with the highest.

The probabilities come from expectation maximisation over word counts of a
bounded sample of labelled documents (``SAMPLE`` per language, about, chosen
by a hash of the id): Spark counts words, each round's tasks compute expected
piece counts by a forward and a backward pass, and Spark adds these up; the
sums, vocabulary times languages at most, make the next probabilities.

Words are runs of letters, lower case, with the vocabulary's mark of a
word's start in front; runs over ``LONGEST`` letters count as several words.
A letter that is no piece counts as the unknown piece.  In scoring, each
task keeps the values of frequent words in a table of fixed size.

Defined cases: a text that is null or has no letter gets ``und`` and score
0, as does every text when no language could be learned; ties go to the
first language in alphabetical order.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apidrift.llm.common import checkpoint, crc_mod, mix64, slices, texts_of

SAMPLE = 1500
ROUNDS = 4
PRIOR = 0.05
LONGEST = 32
MARK = "▁"
UNKNOWN = "und"
KEPT = 1 << 20

_BASE = 0xD1342543DE82EF95
_INV = pow(_BASE, -1, 1 << 64)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    table[0xD800:0xE000] = False
    return table


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class Text:
    """Characters of many strings in one array, with hashes of any span."""

    def __init__(self, chars: np.ndarray):
        n = len(chars)
        size = 1 << max(20, (n + 1).bit_length())
        self.chars = chars
        self.inv = _powers(_INV, size)
        self.acc = np.zeros(n + 1, np.uint64)
        np.cumsum(mix64(chars.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, size)[:n], out=self.acc[1:],
                  dtype=np.uint64)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.acc[end] - self.acc[start]) * self.inv[start] + (end - start).astype(np.uint64))


def _chars(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings and where each begins (and the last ends)."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    data = "".join(strings).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(data, np.uint32), np.concatenate(([0], np.cumsum(size)))


class Vocabulary:
    """Lower-case letter pieces of a vocabulary file; number 0 is the unknown piece."""

    _kept: dict[str, "Vocabulary"] = {}

    @classmethod
    def of(cls, path: str) -> "Vocabulary":
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = (model.id_to_piece(i) for i in range(model.get_piece_size())
                 if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        self.pieces = sorted({p for p in names if (q := p.removeprefix(MARK)).isalpha() and q == q.lower()} | {MARK})
        self.widest = max(map(len, self.pieces))
        chars, at = _chars(self.pieces)
        key = Text(chars).hash(at[:-1], at[1:])
        number = np.arange(1, len(key) + 1)
        # levels of a hash table: what finds its slot taken goes one level on
        self.levels = []
        while len(key):
            shift = np.uint64(46 - 5 * len(self.levels))
            slot = (key >> shift) & np.uint64(0x3FFFF)
            _, first = np.unique(slot, return_index=True)
            keys, numbers = np.zeros(1 << 18, np.uint64), np.zeros(1 << 18, np.int32)
            keys[slot[first]], numbers[slot[first]] = key[first], number[first]
            self.levels.append((shift, keys, numbers))
            rest = np.ones(len(key), bool)
            rest[first] = False
            key, number = key[rest], number[rest]

    def __len__(self) -> int:
        return len(self.pieces) + 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash, 0 where there is none."""
        out = np.zeros(len(h), np.int32)
        for shift, keys, numbers in self.levels:
            slot = (h >> shift) & np.uint64(0x3FFFF)
            out = np.where(keys[slot] == h, numbers[slot], out)
        return out


def lattice(text: Text, start: np.ndarray, size: np.ndarray, vocabulary: Vocabulary):
    """Pieces of words that all have the same length: yields (end, length, numbers of all words)."""
    n = int(size[0])
    for end in range(1, n + 1):
        for wide in range(1, min(end, vocabulary.widest) + 1):
            number = vocabulary.find(text.hash(start + end - wide, start + end))
            if wide == 1 or number.any():
                yield end, wide, number


def word_probabilities(text: Text, start: np.ndarray, size: np.ndarray, vocabulary: Vocabulary,
                       p: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all segmentations: words by languages."""
    out = np.zeros((len(start), p.shape[1]))
    for n in np.unique(size):
        pick = np.flatnonzero(size == n)
        alpha = np.zeros((n + 1, len(pick), p.shape[1]))
        alpha[0] = 1
        for end, wide, number in lattice(text, start[pick], size[pick], vocabulary):
            hit = np.flatnonzero((number > 0) | (wide == 1))
            alpha[end][hit] += alpha[end - wide][hit] * p[number[hit]]
        out[pick] = np.log(alpha[n])
    return out


def expected_counts(text: Text, start: np.ndarray, size: np.ndarray, vocabulary: Vocabulary, p: np.ndarray,
                    counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in all segmentations, pieces by languages; ``counts``: words by languages."""
    out = np.zeros(p.shape)
    for n in np.unique(size):
        pick = np.flatnonzero(size == n)
        cells = list(lattice(text, start[pick], size[pick], vocabulary))
        alpha = np.zeros((n + 1, len(pick), p.shape[1]))
        beta = np.zeros_like(alpha)
        alpha[0] = beta[n] = 1
        used = [(end, wide, number, np.flatnonzero((number > 0) | (wide == 1))) for end, wide, number in cells]
        for end, wide, number, hit in used:
            alpha[end][hit] += alpha[end - wide][hit] * p[number[hit]]
        for end, wide, number, hit in reversed(used):
            beta[end - wide][hit] += beta[end][hit] * p[number[hit]]
        share = counts[pick] / alpha[n]
        for end, wide, number, hit in used:
            np.add.at(out, number[hit], alpha[end - wide][hit] * p[number[hit]] * beta[end][hit] * share[hit])
    return out


def _words(strings: list[str]) -> tuple[Text, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the strings: text with marks, start and length of each (mark included), and its string."""
    chars, at = _chars(strings)
    letter = _is_letter()[chars]
    first = np.zeros(len(chars) + 1, bool)
    first[at] = True
    before = np.concatenate(([False], letter[:-1])) if len(chars) else letter
    after = np.concatenate((letter[1:], [False])) if len(chars) else letter
    start = np.flatnonzero(letter & (~before | first[:-1]))
    end = np.flatnonzero(letter & (~after | first[1:])) + 1
    row = np.searchsorted(at, start, side="right") - 1
    if len(start) and (end - start).max() > LONGEST:
        parts = -(-(end - start) // LONGEST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, end, row = np.repeat(start, parts) + nth * LONGEST, np.repeat(end, parts), np.repeat(row, parts)
        end = np.minimum(end, start + LONGEST)
    size = end - start
    # the character before a word makes way for the mark; words at the very
    # start or right behind another part get one inserted
    to = np.cumsum(size + 1) - size - 1
    marked = np.full(int((size + 1).sum()), ord(MARK), np.uint32)
    source = np.repeat(start - to - 1, size + 1) + np.arange(len(marked))
    is_mark = np.zeros(len(marked), bool)
    is_mark[to] = True
    marked[~is_mark] = chars[source[~is_mark]]
    return Text(marked), to, size + 1, row


class Scorer:
    """Log probabilities of words by language, with a table of fixed size for frequent words."""

    def __init__(self, vocabulary: Vocabulary, p: np.ndarray):
        self.vocabulary, self.p = vocabulary, p
        self.key = np.zeros(KEPT, np.uint64)
        self.value = np.zeros((KEPT, p.shape[1]), np.float32)

    def __call__(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Score of each string in each language, and its number of words."""
        text, start, size, row = _words(strings)
        n = np.bincount(row, minlength=len(strings))
        if not len(start):
            return np.zeros((len(strings), self.p.shape[1])), n
        h = text.hash(start, start + size)
        slot = (h & np.uint64(KEPT - 1)).astype(np.int64)
        value = self.value[slot]
        new = np.flatnonzero(self.key[slot] != h)
        if len(new):
            _, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            pick = new[first]
            got = word_probabilities(text, start[pick], size[pick], self.vocabulary, self.p).astype(np.float32)
            value[new] = got[back]
            self.key[slot[pick]], self.value[slot[pick]] = h[pick], got
            # of words that share a slot the last one written stays, in both arrays alike
        total = np.zeros((len(strings), self.p.shape[1]))
        acc = np.zeros((len(start) + 1, self.p.shape[1]))
        np.cumsum(value, axis=0, dtype=np.float64, out=acc[1:])
        ends = np.searchsorted(row, np.arange(len(strings) + 1))
        total[:] = acc[ends[1:]] - acc[ends[:-1]]
        return total, n


def learn(docs: DataFrame, vocabulary: str | None = None, sample: int = SAMPLE,
          rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (pieces by languages) from labelled rows.

    ``docs`` has ``doc_id``, ``text`` and ``lang``; rows without a language
    are left out.
    """
    path = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    rows = texts_of(docs, F.col("lang").cast("string").alias("lang")).where("lang is not null")
    # a row for each language in the data: a few, whatever the data's size
    have = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(have)
    size = len(Vocabulary.of(path))
    if not langs:
        return [], np.zeros((size, 0))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample / have[k]))])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000
    number = F.create_map(*[F.lit(x) for i, k in enumerate(langs) for x in (k, i)])
    words = F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))
    counts = (rows.where(drawn).select(number[F.col("lang")].alias("lang"), words.alias("word"))
              .where("word <> ''").groupBy("word", "lang").agg(F.count("*").alias("n")))
    counts = checkpoint(counts.repartition(8, "word"))
    k = len(langs)

    p = np.full((size, k), 1.0 / size)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(p)

        def expect(batches, sent=sent):
            vocab, total = Vocabulary.of(path), np.zeros(sent.value.shape)
            for batch in batches:
                text, start, width, row = _words(batch.column(0).to_pylist())
                c = np.zeros((len(start), k))
                lang, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                c[np.arange(len(start)), lang[row]] = n[row]
                if len(start):
                    total += expected_counts(text, start, width, vocab, sent.value, c)
            cell = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel()[cell])], names=["cell", "n"])

        # tasks put out the cells that they touched, and Spark adds them up: one
        # number for each piece and language, however many tasks there are
        got = (counts.select("word", "lang", "n").mapInArrow(expect, "cell long, n double")
               .groupBy("cell").agg(F.sum("n").alias("n")).toArrow())
        total = np.full(size * k, PRIOR)
        total[got.column("cell").to_numpy()] += got.column("n").to_numpy()
        total = total.reshape(size, k)
        p = total / total.sum(axis=0)
        sent.unpersist()
    return langs, p


def predict(docs: DataFrame, langs: list[str], p: np.ndarray, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, lang_pred, score) of each row; only ``text`` decides."""
    path = vocabulary or default_vocabulary()
    sent = docs.sparkSession.sparkContext.broadcast(p)

    def run(batches):
        scorer = Scorer(Vocabulary.of(path), sent.value) if langs else None
        for batch in batches:
            for lo, hi in slices(batch.column(1), 4 << 20):
                text = batch.column(1).slice(lo, hi - lo).to_pylist()
                pred, score = np.full(hi - lo, UNKNOWN, object), np.zeros(hi - lo)
                if scorer:
                    total, n = scorer(text)
                    best, some = total.argmax(axis=1), n > 0
                    pred[some] = np.array(langs, object)[best[some]]
                    e = np.exp(total - total.max(axis=1, keepdims=True))
                    score[some] = (1 / e.sum(axis=1))[some]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(pred, pa.string()), pa.array(score)],
                    names=["doc_id", "lang_pred", "score"])

    lower = texts_of(docs).withColumn("text", F.lower("text"))
    return lower.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out():
    """Rows that are never learned from."""
    return crc_mod(F.col("doc_id"), 4) == 2
