"""How filters on texts interact: what each removes in every order, alone and together.

Five filters, each a bit of a document's failure set:

- A: under 50 words (maximal runs of anything but ASCII white space);
- B: 100 times the distinct words are under 65 times the words;
- C: 100 times the letters A-Z are over 5 times the code points;
- D: the text holds one of ``#$%&*|``;
- E: the text is that of another document with a smaller id.

A to D are expressions over one document.  E is an existential self-join: a
left-semi join on a hash of the text, the text itself and a smaller id.  Only
texts whose hash is met twice take part; the other side is one row a text, the
one with the smallest id, grouped before the shuffle.  Texts that more than one
in a thousand documents share, of which there are at most a thousand, are
salted: their copies are dealt over as many tasks as their number asks for.
The failing ids of all filters are united and their bits put together; what
goes on from there is a count for each part and set of bits, at most 32 a part.

Defined cases: null text counts as empty (0 words: A fails, B and C don't);
a null id is neither smaller than others nor has it smaller ones; rows that are
repeated count as often as they come; a null source is the part of the empty
string; ids labelled more than once count as good or toxic if one label says so.
An empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apidrift.llm.common import checkpoint, phase

FILTERS = "ABCDE"
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
HOT = 1000

_KEY = ["doc_id", "part", "hash", "size"]


def own_bits(text: Column) -> Column:
    """Bits of the filters that one text decides."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    few = F.size(words) < 50
    dull = 100 * F.size(F.array_distinct(words)) < 65 * F.size(words)
    loud = 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 5 * F.length(text).cast("long")
    marks = text.rlike(r"[#$%&*|]")
    return sum((F.when(x, BIT[name]).otherwise(0) for name, x in zip("ABCD", (few, dull, loud, marks), strict=True)),
               F.lit(0))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"),
                       F.xxhash64(text).alias("hash"), F.length(text).alias("size"))


def repeated(rows: DataFrame, marks: DataFrame, hot: int = HOT) -> DataFrame:
    """Rows (without text) whose text a row with a smaller id has, by a left-semi join.

    ``marks`` are the rows without their texts.
    """
    shared = checkpoint(marks.groupBy("hash", "size").agg(F.count("*").alias("n")).where("n > 1"))
    total = marks.count()
    # texts of more than one in ``hot`` rows: at most ``hot`` of them
    chunk = max(4096, total // hot)
    busy = F.broadcast(shared.where(F.col("n") > chunk).select(
        "hash", "size", F.ceil(F.col("n") / chunk).cast("int").alias("salts")))
    some = rows.join(shared.select("hash", "size"), ["hash", "size"], "left_semi")
    some = some.join(busy, ["hash", "size"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    mine = some.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.col("salts")).cast("int"))
    first = (some.where("doc_id is not null").groupBy("hash", "text", "salts").agg(F.min("doc_id").alias("first"))
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))))
    a, b = mine.alias("a"), first.alias("b")
    same = ((F.col("a.hash") == F.col("b.hash")) & (F.col("a.salt") == F.col("b.salt"))
            & (F.col("a.text") == F.col("b.text")) & (F.col("b.first") < F.col("a.doc_id")))
    return a.join(b, same, "left_semi").select(*_KEY)


def combinations(docs: DataFrame, labels: DataFrame, hot: int = HOT) -> DataFrame:
    """(part, bits, n, good, toxic): documents of each part by the set of filters they fail; a set of 0 fails none."""
    rows = _rows(docs)
    marks = checkpoint(rows.select(*_KEY, own_bits(F.col("text")).alias("bits")))
    again = repeated(rows, marks, hot).withColumn("bits", F.lit(BIT["E"]))
    failing = marks.where("bits > 0").unionByName(again)
    # rows that agree in id, part and text are in all of the united sets equally often
    failing = failing.groupBy(*_KEY).agg(
        F.bit_or("bits").alias("bits"), F.greatest(F.sum(F.when(F.col("bits") == BIT["E"], 0).otherwise(1)),
                                                   F.sum(F.when(F.col("bits") == BIT["E"], 1).otherwise(0))).alias("n"))
    failing = phase(failing.select("doc_id", "part", "bits", "n"))
    said = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"),
                          (F.col("toxic") == 1).alias("toxic"))
            .where("doc_id is not null AND (good OR toxic)").groupBy("doc_id")
            .agg(F.coalesce(F.max("good"), F.lit(False)).cast("int").alias("good"),
                 F.coalesce(F.max("toxic"), F.lit(False)).cast("int").alias("toxic")))
    none = F.lit(0).cast("long")
    counted = failing.select("part", "bits", "n", none.alias("good"), none.alias("toxic"))
    labelled = failing.join(said, "doc_id").select("part", "bits", none.alias("n"), (F.col("n") * F.col("good")).alias("good"),
                                                   (F.col("n") * F.col("toxic")).alias("toxic"))
    # those that fail no filter: all of a part less its failing ones
    every = marks.select("part", F.lit(0).alias("bits"), F.lit(1).cast("long").alias("n"), none.alias("good"),
                         none.alias("toxic"))
    less = failing.select("part", F.lit(0).alias("bits"), (-F.col("n")).alias("n"), none.alias("good"), none.alias("toxic"))
    return (counted.unionByName(labelled).unionByName(every).unionByName(less)
            .groupBy("part", "bits").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")))


def steps(counts: DataFrame) -> DataFrame:
    """The audit: a row for each part, order of the filters and step, from ``combinations``."""
    sets = counts.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("sets"))
    plan = [F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(i + 1).alias("step"),
                     F.lit(BIT[name]).alias("own"), F.lit(sum(BIT[x] for x in order[:i])).alias("before"))
            for order in permutations(FILTERS) for i, name in enumerate(order)]
    each = sets.withColumn("s", F.explode(F.array(*plan))).select("part", "sets", "s.*")
    own, before = F.col("own"), F.col("before")

    def total(field: str, keep) -> Column:
        return F.aggregate(F.filter("sets", lambda x: keep(x["bits"])), F.lit(0).cast("long"), lambda acc, x: acc + x[field])

    def fails(bits):
        return bits.bitwiseAND(own) != 0

    def reached(bits):
        return bits.bitwiseAND(before) == 0

    # of all orders, a set's own filter comes first in one of as many as the set has filters
    all_orders = F.aggregate(F.filter("sets", lambda x: fails(x["bits"])), F.lit(0).cast("long"),
                             lambda acc, x: acc + (x["n"] * F.lit(120) / F.bit_count(x["bits"])).cast("long"))
    return each.select(
        "part", "filter_order", "step",
        total("n", lambda b: b.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total("n", lambda b: fails(b) & reached(b)).alias("removed"),
        total("n", lambda b: fails(b) & ~reached(b)).alias("redundant"),
        total("n", lambda b: b == own).alias("unique_fails"),
        total("good", lambda b: fails(b) & reached(b)).alias("good_lost"),
        total("toxic", lambda b: fails(b) & reached(b)).alias("toxic_lost"),
        all_orders.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, hot: int = HOT) -> DataFrame:
    """A row for each part, order and step; counts are longs."""
    return steps(combinations(docs, labels, hot))
