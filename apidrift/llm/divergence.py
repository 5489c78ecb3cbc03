"""Quality rules by distribution divergence, in DataFrame functions only.

Every language of the table has two references, from all its documents: the
shares of seven classes of characters, and the shares of its ``COMMON`` most
frequent words, all others being one more word.  A document's own
distributions are compared with each language's by the Jensen-Shannon
distance (base 2, 0 to 1), and the nearest language counts.  A document is
kept if neither distance is over its limit.  Short documents say little, so
each comparison has a least number of words under which it isn't made.

The base rules come first: too few words, or too many words in repeated
three-word windows.

References have a bounded size (languages times words); the word counts
behind them are added up in tasks before they are shuffled.  Scoring is one
scan without a shuffle: a document's words are looked up in a small table by
hash and counted by sorting.

Defined cases: null text has no words and fails the base rules; a null
language adds to no reference, and its documents are judged like all
others; without references only the base rules count; repeated rows are
judged alike; ties among frequent words go to the first in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apidrift.llm.common import checkpoint

COMMON = 24
LEAST_WORDS = 50
CHARACTER_LIMIT = 0.28
WORD_LIMIT = 0.35
CHARACTERS_FROM = 50
WORDS_FROM = 100

#: Classes of characters, among them the white space and the symbols of the base rules.
CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "space": r"\x20\x09-\x0D", "stop": r".,;:!?'\"()\-",
           "symbol": r"#*$%&|<>"}
# Bits of a window's place and of its hash in one number; texts with more words, or with windows
# that share a hash and differ, go by whole hashes.
_POSITION = 23
_HASH = 39


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _count(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.col("lang").cast("string").alias("lang"))


def _marks(text: Column) -> Column:
    """What is neither a lower-case letter nor white space: little of most texts, and the other classes are in it."""
    return F.regexp_replace(text, f"[{CLASSES['lower']}{CLASSES['space']}]+", "")


def _classes(text: Column, words: Column, marks: Column) -> list[Column]:
    """Characters of each class; those outside of words are white space."""
    inside = F.length(F.array_join(words, ""))
    own = {"space": F.length(text) - inside, "lower": inside - F.length(marks)}
    return [(own[name] if name in own else _count(marks, chars)).alias(f"c_{name}") for name, chars in CLASSES.items()]


def references(docs: DataFrame, common: int = COMMON) -> tuple[dict, dict]:
    """Per language: shares of character classes (the rest last), and of its common words."""
    rows = _texts(docs).where("lang is not null")
    sums = rows.select("lang", "text", _words(F.col("text")).alias("words"), _marks(F.col("text")).alias("marks")).select(
        "lang", F.length("text").alias("n"), F.size("words").alias("words"),
        *_classes(F.col("text"), F.col("words"), F.col("marks"))).groupBy("lang").agg(
        F.sum("n").alias("n"), F.sum("words").alias("words"), *[F.sum(f"c_{c}").alias(c) for c in CLASSES])
    chars, total = {}, {}
    for r in sums.collect():  # a row for each language
        total[r["lang"]] = r["words"]
        own = [r[c] for c in CLASSES]
        chars[r["lang"]] = [x / r["n"] for x in [*own, r["n"] - sum(own)]] if r["n"] else None
    chars = {k: v for k, v in chars.items() if v}

    word = rows.select("lang", F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    counts = word.groupBy("lang", "word").agg(F.count("*").alias("n"))
    counts = checkpoint(counts.withColumn("nth", F.row_number().over(
        Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("nth") <= common))
    words: dict[str, dict] = {}
    # ``common`` rows for each language
    for r in counts.select("lang", "word", "n", F.xxhash64("word").alias("hash")).collect():
        words.setdefault(r["lang"], {})[r["word"]] = (r["n"] / total[r["lang"]], r["hash"])
    return chars, words


def _array(values: list, kind: str) -> Column:
    return F.expr(f"array({', '.join(f'{v}{kind}' for v in values)})") if values else F.expr("array()")


def _part(p: Column, q: Column) -> Column:
    """What one bin adds to the divergence; nothing stands for p log p at 0."""
    m = (p + q) / 2
    return (F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)) / 2


def _character_distance(chars: dict) -> Column:
    """Least distance of the document's character shares from a language's."""
    n = F.col("n_chars")
    own = [F.col(f"c_{c}") for c in CLASSES]
    share = [x / n for x in [*own, n - sum(own[1:], own[0])]]
    each = [sum((_part(p, F.lit(float(q))) for p, q in zip(share, ref, strict=True)), F.lit(0.0))
            for ref in chars.values()]
    return F.sqrt(F.greatest(F.lit(0.0), F.least(*each) if len(each) > 1 else each[0]))


def judge(docs: DataFrame, chars: dict, words: dict) -> DataFrame:
    """Counts of the base rules, distances and the verdict for each row of ``docs``."""
    vocabulary = sorted({(w, h) for ref in words.values() for w, (_, h) in ref.items()})
    size = 1024
    while len({h % size for _, h in vocabulary}) < len(vocabulary):
        size *= 2
    slots: list[int] = [0] * size
    for _, h in vocabulary:
        slots[h % size] = h
    table = _array(slots, "L")

    text, parts = F.col("text"), F.col("words")
    rows = _texts(docs).select("doc_id", "text", _words(text).alias("words"), _marks(text).alias("marks"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    mask = (1 << _HASH) - 1
    none = F.expr("cast(array() as array<bigint>)")

    def hashed(i: Column) -> Column:
        return F.xxhash64(F.get(parts, i), F.get(parts, i + 1), F.get(parts, i + 2))

    def window(i: Column) -> Column:
        return F.shiftleft(hashed(i).bitwiseAND(F.lit(mask)), _POSITION).bitwiseOR(i.cast("long"))

    def slot(w: Column) -> Column:
        h = F.xxhash64(F.lower(w))
        at = F.pmod(h, F.lit(size)).cast("int")
        return F.when(F.get(table, at) == h, at).otherwise(F.lit(-1))

    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 3, F.lit(0)))
    wide = F.size("words") > (1 << _POSITION)
    rows = rows.select(
        "doc_id", "words", F.size("words").cast("long").alias("n_words"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.length(text).alias("n_chars"), *_classes(text, parts, F.col("marks")),
        F.when((F.size("words") >= 3) & ~wide, F.sort_array(F.transform(starts, window))).otherwise(none).alias("windows"),
        F.sort_array(F.filter(F.transform(parts, slot), lambda x: x >= 0)).alias("slots"))
    kept = [c for c in rows.columns if c not in ("words", "windows", "slots")]

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit((1 << _POSITION) - 1)).cast("int")

    def same(a: Column, b: Column) -> Column:
        return ((F.get(parts, a) == F.get(parts, b)) & (F.get(parts, a + 1) == F.get(parts, b + 1))
                & (F.get(parts, a + 2) == F.get(parts, b + 2)))

    # of windows sorted by hash and place, equal ones are neighbours; the words themselves decide: 1 where
    # a window is that before it, 2 where only their hashes agree
    def meets(x: Column, y: Column, equal_hash: Column, at) -> Column:
        return F.when(equal_hash, F.when(same(at(x), at(y)), 1).otherwise(2)).otherwise(0)

    windows = F.col("windows")
    before = F.transform(windows, lambda x, j: F.when(j > 0, meets(
        x, F.get(windows, j - 1), F.shiftright(x, _POSITION) == F.shiftright(F.get(windows, j - 1), _POSITION), place
    )).otherwise(0))
    rows = rows.withColumn("before", before)
    again = wide | F.array_contains("before", 2)
    rows = rows.withColumn("whole", F.when(again, F.sort_array(F.transform(
        starts, lambda i: F.struct(hashed(i).alias("h"), i.alias("i"))))))
    whole = F.col("whole")
    rows = rows.withColumn("before", F.when(whole.isNull(), F.col("before")).otherwise(F.transform(
        whole, lambda x, j: F.when(j > 0, meets(x, F.get(whole, j - 1), x["h"] == F.get(whole, j - 1)["h"],
                                                lambda y: y["i"])).otherwise(0))))
    number = F.col("before")
    met = F.filter(F.sequence(F.lit(0), F.size(number)), lambda j: (F.get(number, j) == 1) | (F.get(number, j + 1) == 1))
    seen = F.col("slots")
    rows = rows.select(
        *kept, F.sort_array(F.when(whole.isNull(), F.transform(met, lambda j: place(F.get(windows, j)))).otherwise(
            F.transform(met, lambda j: F.get(whole, j)["i"]))).alias("places"), "slots",
        F.filter(F.sequence(F.lit(0), F.size(seen)), lambda i: (i == 0) | (F.get(seen, i) != F.get(seen, i - 1))
                 | (i == F.size(seen))).alias("firsts"))
    places, firsts = F.col("places"), F.col("firsts")
    covered = F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3))))
    found = F.transform(F.slice(firsts, 1, F.greatest(F.lit(0), F.size(firsts) - 1)), lambda i, j: F.struct(
        F.get(seen, i).alias("slot"), ((F.get(firsts, j + 1) - i) / F.col("n_words")).alias("share")))
    rows = rows.select(
        *kept, F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
        F.when(F.size(seen) > 0, found).otherwise(
            F.expr("cast(array() as array<struct<slot:int,share:double>>)")).alias("found"))

    # a bin that the document lacks adds half its share
    def divergence(ref: dict) -> Column:
        q = [0.0] * size
        for share, h in ref.values():
            q[h % size] = share
        shares = _array(q, "D")
        mine = F.filter("found", lambda f: F.get(shares, f["slot"]) > 0)
        common = F.aggregate(mine, F.lit(0.0), lambda a, f: a + f["share"])
        bins = F.aggregate(mine, F.lit(sum(q) / 2), lambda a, f: a
                           + _part(f["share"], F.get(shares, f["slot"])) - F.get(shares, f["slot"]) / 2)
        return bins + _part(F.greatest(F.lit(0.0), 1 - common), F.lit(max(0.0, 1 - sum(q))))

    each = [divergence(ref) for ref in words.values()]
    word_distance = F.sqrt(F.greatest(F.lit(0.0), F.least(*each) if len(each) > 1 else each[0])) if each else F.lit(0.0)
    distance = _character_distance(chars) if chars else F.lit(0.0)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.select(
        "doc_id", "n_words", (F.col("n_chars") - F.col("c_space")).cast("long").alias("word_chars"),
        F.col("c_symbol").cast("long").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.when(F.col("n_words") >= CHARACTERS_FROM, distance).otherwise(0.0).alias("character_distance"),
        F.when(F.col("n_words") >= WORDS_FROM, word_distance).otherwise(0.0).alias("word_distance"))
    fits = (F.col("character_distance") <= CHARACTER_LIMIT) & (F.col("word_distance") <= WORD_LIMIT)
    return rows.withColumn("kept", ~F.col("base_failed") & fits)


def rules(docs: DataFrame) -> DataFrame:
    """Judges ``docs`` by the references of its own languages."""
    return judge(docs, *references(docs))
