"""Benchmark items in training documents, by BM25 with block-max WAND.

The index holds test items, cut into segments of ``SEGMENT`` words at most.
A segment's BM25 impacts are divided by its score against itself, so 1
means that a passage has all its words and one threshold fits all lengths.
Every document is cut into passages of ``2 * HALF`` words that overlap by
half, and every passage is a query.

Segments lie in blocks.  For each passage the greatest impacts of its words
in each block are added up, for a whole slice of documents at once; only
passages that could reach the threshold somewhere go on to block-max WAND,
which returns all segments whose score is above it.  A hit counts when the
document also holds both the item's question and its answer (the part behind
the last line end), whichever of its segments was hit: at least ``OVERLAP`` of
the part's five-word runs, or of those of one stretch of a part with more than
``SEGMENT`` runs.  A part of fewer than five words is one run of all its words.

The index goes to the tasks in shards of ``SHARD_WORDS`` words, so what is
broadcast doesn't grow with the benchmark; its word statistics are those of
the whole benchmark.

Defined cases: null texts are empty; an empty text has no passage; items
without words are never found; a part without words asks for nothing; texts
that share an id are one item, found with any of them; a repeated document is
found as often as it occurs, and ``matches`` names each pair of ids once.  No
items: no matches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apidrift.llm import wordhash
from apidrift.llm.common import ROW, buffers, checkpoint, packed, slices, texts_of

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.5
RUN = 5
SEGMENT = 64
HALF = 48
BLOCK = 2
SHARD_WORDS = 20_000
HALVES = 2048
_WORD_GAP = r"[^0-9a-z\x{80}-\x{10FFFF}]+"


def segments(items: DataFrame) -> DataFrame:
    """(item_id, segment, words, n_question, text_key, key, df): words of each segment, how many of
    them are the question's, and the number of segments that have each of its words.

    ``items`` has ``item_id`` and ``text``.
    """
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))

    def words(c):
        return F.filter(F.split(c, _WORD_GAP), lambda w: w != "")

    answer = F.when(F.instr(text, "\n") > 0, F.regexp_extract(text, r"(?s)^.*\n(.*)$", 1)).otherwise("")
    question = F.expr("substring(t, 1, length(t) - length(a))")
    parts = (items.select(F.col("item_id").cast("long").alias("item_id"), text.alias("t"), answer.alias("a"))
             .select("item_id", words(question).alias("q"), words(F.col("a")).alias("w")))
    both = parts.select("item_id", F.size("q").alias("n_question"), F.concat("q", "w").alias("words"))
    both = both.withColumn("text_key", F.xxhash64("item_id", "n_question", "words"))
    # segments of one text are equally long, so that none is a short rest
    n = F.ceil(F.size("words") / SEGMENT).cast("int")
    size = F.ceil(F.size("words") / n).cast("int")
    cut = both.where(F.size("words") > 0).select(
        "item_id", "words", "n_question", "text_key", size.alias("size"), F.explode(F.sequence(F.lit(0), n - 1)).alias("segment"))
    first = F.col("segment") * F.col("size")
    own = F.slice("words", first + 1, F.col("size"))
    cut = cut.select("item_id", "text_key", "segment", own.alias("words"),
                     F.greatest(F.lit(0), F.least(F.size(own), F.col("n_question") - first)).alias("n_question"))
    cut = cut.where(F.size("words") > 0)
    cut = cut.withColumn("key", F.xxhash64("text_key", "segment")).dropDuplicates(["key"])
    each = cut.select("key", "item_id", "segment", F.explode(F.array_distinct("words")).alias("word"))
    df = each.groupBy("word").agg(F.count("*").alias("df"))
    known = each.join(df, "word").groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("word", "df"))).alias("df"))
    return cut.join(known, "key")


class Index:
    """An inverted index of segments in blocks, small enough to send to a task."""

    def __init__(self, rows: list, n: int, mean: float):
        """rows: of ``segments``; n and mean: number and mean length of all segments."""
        # the texts of items: their ids, and the runs of question and answer, width and stretches
        self.items, self.runs, self.text_of = [], [], []
        whole: dict[int, list] = {}
        for r in rows:
            whole.setdefault(r["text_key"], []).append(r)
        place = {key: i for i, key in enumerate(whole)}
        for own in whole.values():
            own.sort(key=lambda r: r["segment"])
            h = _hash_words([w for r in own for w in r["words"]])
            n_question = sum(r["n_question"] for r in own)
            self.items.append(own[0]["item_id"])
            self.runs.append([])
            for part in (h[:n_question], h[n_question:]):
                runs = _runs(part, min(len(part), RUN))
                self.runs[-1].append((min(len(part), RUN), np.array_split(runs, max(1, -(-len(runs) // SEGMENT)))))
        postings = []
        for s, r in enumerate(rows):
            self.text_of.append(place[r["text_key"]])
            words = list(r["words"])
            h = _hash_words(words)
            term, at, tf = np.unique(h, return_index=True, return_counts=True)
            df = np.array([r["df"][words[i]] for i in at], float)
            idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
            impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
            postings += [(t, s, w) for t, w in zip(term, impact / impact.sum(), strict=True)]
        self.terms = np.unique(np.array([p[0] for p in postings], np.uint64))
        number = {t: i for i, t in enumerate(self.terms)}
        self.lists: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        self.most = np.zeros((len(self.terms), -(-len(rows) // BLOCK)), np.float32)
        for t, s, w in postings:
            i = number[t]
            self.lists[i].append((s, w))
            self.most[i, s // BLOCK] = max(self.most[i, s // BLOCK], w * (1 + 1e-6))
        self.top = self.most.max(axis=1) if len(rows) else np.zeros(0)
        self.seen = np.zeros(1 << 18, bool)
        self.seen[self.terms >> np.uint64(46)] = True

    def numbers(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` of words in the index, and their term numbers."""
        at = np.flatnonzero(self.seen[h >> np.uint64(46)])
        i = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        hit = self.terms[i] == h[at]
        return at[hit], i[hit]

    def search(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All segments that score ``least`` or more for a set of terms: block-max WAND."""
        lists = [[0, self.lists[t], float(self.top[t]), self.most[t]] for t in terms]
        found = []
        while lists:
            lists.sort(key=lambda x: x[1][x[0]][0])
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                bound += x[2]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = lists[pivot][1][lists[pivot][0]][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][1][lists[pivot + 1][0]][0] == doc:
                pivot += 1
            block = doc // BLOCK
            if sum(float(x[3][block]) for x in lists[:pivot + 1]) < least:
                # no segment of this block can do it with these lists
                to = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    to = min(to, lists[pivot + 1][1][lists[pivot + 1][0]][0])
                to = max(to, doc + 1)
            elif lists[0][1][lists[0][0]][0] == doc:
                score = sum(x[1][x[0]][1] for x in lists[:pivot + 1])
                if score >= least:
                    found.append((doc, score))
                to = doc + 1
            else:
                to = doc
            for x in lists[:pivot + 1]:
                while x[0] < len(x[1]) and x[1][x[0]][0] < to:
                    x[0] += 1
            lists = [x for x in lists if x[0] < len(x[1])]
        return found

    def hits(self, column: pa.Array, least: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple]:
        """(row, item_id, score, question_overlap, answer_overlap) for a slice of lower-case texts."""
        data, offsets = buffers(column)
        n_rows = len(offsets) - 1
        start, end, row = wordhash.spans(data, offsets)
        if not len(start) or not len(self.terms):
            return []
        h = wordhash.hashes(data, start, end)
        at, term = self.numbers(h)
        if not len(at):
            return []
        count = np.bincount(row, minlength=n_rows)
        first_word = np.concatenate(([0], np.cumsum(count)))
        halves = -(-count // HALF)
        first_half = np.concatenate(([0], np.cumsum(halves)))
        half = first_half[row[at]] + (at - first_word[row[at]]) // HALF
        n = len(self.terms)
        pair = np.unique(half * n + term)
        half, term = pair // n, pair % n
        begin = np.flatnonzero(np.concatenate(([True], half[1:] != half[:-1])))
        here = half[begin]
        stop = np.append(begin[1:], len(half))
        row_of = np.searchsorted(first_half, here, side="right") - 1
        # a passage is a half and the next one of the same document, if it has words of the index
        follows = np.zeros(len(here), bool)
        follows[:-1] = (here[1:] == here[:-1] + 1) & (row_of[1:] == row_of[:-1])
        best: dict[tuple[int, int], float] = {}
        # sums for some halves at a time, so that memory doesn't grow with the length of a text
        for lo in range(0, len(here), HALVES):
            hi = min(lo + HALVES + 1, len(here))
            bound = np.add.reduceat(self.most[term[begin[lo]:stop[hi - 1]]], begin[lo:hi] - begin[lo], axis=0)
            both = bound.copy()
            both[:-1][follows[lo:hi - 1]] += bound[1:][follows[lo:hi - 1]]
            for k in lo + np.flatnonzero((both[:HALVES] >= least).any(axis=1)):
                t = term[begin[k]:stop[k + 1] if follows[k] else stop[k]]
                for s, score in self.search(np.unique(t).tolist(), least):
                    key = (int(row_of[k]), self.text_of[s])
                    best[key] = max(best.get(key, 0.0), score)
        out, runs = [], {}

        def share(r: int, width: int, stretches: list) -> float | None:
            if not width:
                return None
            if (r, width) not in runs:
                runs[r, width] = np.unique(_runs(h[first_word[r]:first_word[r + 1]], width))
            return max(float(np.isin(own, runs[r, width]).mean()) for own in stretches)

        for (r, i), score in sorted(best.items()):
            found = [share(r, *part) for part in self.runs[i]]
            if any(x is not None for x in found) and all(x is None or x >= overlap for x in found):
                out.append((r, self.items[i], float(score), found[0], found[1]))
        return out


def _runs(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; none if there are fewer."""
    if not width or len(words) < width:
        return np.zeros(0, np.uint64)
    return wordhash.shingles(words, np.zeros(len(words), np.int64), 1, width)[0]


def _hash_words(words: list[str]) -> np.ndarray:
    data, offsets = buffers(pa.array([" ".join(words)]))
    start, end, _ = wordhash.spans(data, offsets)
    return wordhash.hashes(data, start, end)


def indexes(items: DataFrame) -> list[Index]:
    """The index of all items, in shards of bounded size."""
    cut = checkpoint(segments(items))
    n, words = cut.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    if not n:
        return []
    shards = -(-words // SHARD_WORDS)
    out = []
    for k in range(shards):
        # one shard at a time: about SHARD_WORDS words, and all segments of a text
        own = cut.where(F.pmod("text_key", F.lit(shards)) == k) if shards > 1 else cut
        out.append(Index(own.orderBy("item_id", "text_key", "segment").collect(), n, words / n))
    return out


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): the best hit of each pair."""
    shape = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    found = docs.sparkSession.createDataFrame([], shape)
    lower = texts_of(docs).withColumn("text", F.lower("text"))
    for index in indexes(items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for lo, hi in slices(batch.column(1)):
                    hits = sent.value.hits(batch.column(1).slice(lo, hi - lo))
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": pa.array([ids[lo + x[0]] for x in hits], pa.int64()),
                         **{name: pa.array([x[k] for x in hits], kind) for k, (name, kind) in enumerate(
                             [("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()),
                              ("answer_overlap", pa.float64())], 1)}})

        found = found.unionByName(lower.mapInArrow(run, shape))
    return found.groupBy("doc_id", "item_id").agg(
        F.max("score").alias("score"), F.max("question_overlap").alias("question_overlap"),
        F.max("answer_overlap").alias("answer_overlap"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows in which an item was found."""
    rows = packed(docs, F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__text"))
    for index in indexes(items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for lo, hi in slices(batch.column("__text")):
                    keep[[lo + x[0] for x in sent.value.hits(batch.column("__text").slice(lo, hi - lo))]] = False
                yield batch.filter(pa.array(keep))

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select(f"{ROW}.*")
