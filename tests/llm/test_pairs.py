"""Near-duplicates, line dedup and repeated byte strings against brute force."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
import regex

from apidrift.llm import dart_minhash, line_dedup, lpf_dedup
from apidrift.llm.graph import components

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, id string, content int, row_ string"


def words(rng, n, pool=400):
    return [f"w{int(rng.random() ** 2 * pool)}é" if rng.random() < 0.1 else f"w{int(rng.random() ** 2 * pool)}"
            for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = []
    base = [words(rng, rng.randint(20, 120), 4000) for _ in range(25)]
    for b in base:
        for _ in range(rng.randint(1, 4)):
            w = list(b)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            lines = [" ".join(w[i:i + 12]) for i in range(0, len(w), 12)]
            if rng.random() < 0.4:
                lines.insert(rng.randrange(len(lines) + 1), "The same line in many documents, as a notice of rights is.")
            out.append("\n".join(lines))
    out += ["", None, "one two", "One, TWO!", "aaaa " * 400, "aaaa " * 300, "\n\n", "b" * 49, "b" * 50, "b" * 130]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "clash", i, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SHAPE).repartition(5).cache()


def shingles(t):
    w = regex.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    return collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def classes(texts):
    s = [shingles(t) for t in texts]
    root = list(range(len(s)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            inter, union = sum((s[i] & s[j]).values()), sum((s[i] | s[j]).values())
            if union and inter >= 0.8 * union - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(s))]


def test_near_duplicates_match_brute_force(docs, texts):
    got = {r["id"]: (r["class_id"], r["kept"]) for r in dart_minhash.classes(docs).collect()}
    want = classes(texts)
    assert got == {i: (c, c == i) for i, c in enumerate(want)}
    kept = dart_minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_near_duplicates_edge_rows(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, "z y x w v u"), (2, None), (3, ""),
            (1, "another text of the same id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = dart_minhash.drop_near_duplicates(frame).collect()
    assert sorted(((r[0], r[1]) for r in kept), key=str) == sorted(
        [(1, "a b c d e f g"), (None, "z y x w v u"), (2, None), (3, ""), (1, "another text of the same id")], key=str)
    assert dart_minhash.classes(frame.limit(0)).collect() == []


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    b = np.concatenate([a[:240], rng.integers(0, 2**63, 60, dtype=np.uint64)])
    cells, row = dart_minhash.cells(np.concatenate([a, a[:50], b]), np.repeat([0, 1], [350, 300]))
    sig = dart_minhash.signatures(cells, row, 2, 2000)
    assert np.isfinite(sig).all()
    assert abs((sig[0] == sig[1]).mean() - 240 / (350 + 300 - 240)) < 0.05


def test_components(spark):
    links = [("c", "b"), ("b", "a"), ("e", "d"), ("f", "f"), *[(f"n{i:03}", f"n{i + 1:03}") for i in range(40)]]
    got = dict(components(spark.createDataFrame(links, "a string, b string"), "a", "b").collect())
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", **{f"n{i:03}": "n000" for i in range(41)}}


def line_sets(texts):
    out = []
    for d, t in enumerate(texts):
        for i, line in enumerate((t or "").split("\n")):
            s = frozenset(x for x in regex.split(r"[^\p{L}\p{N}]+", line.lower()) if x)
            if s:
                out.append((d, i, s))
    return out


def test_lines_match_brute_force(docs, texts):
    lines = line_sets(texts)
    want = {}
    for d, i, s in lines:
        like = [(e, j, r) for e, j, r in lines if len(s & r) >= 0.8 * len(s | r) - 1e-9]
        want[d, i] = (min((e, j) for e, j, _ in like) < (d, i), len({r for _, _, r in like} - {s}),
                      min((e, j) for e, j, _ in like)[0])
    got = {(r["id"], r["at"]): (r["removed"], r["links"], r["first_id"]) for r in line_dedup.matches(docs).collect()}
    assert got == want
    kept = {r["doc_id"]: r for r in line_dedup.drop_lines(docs).collect()}
    for d, t in enumerate(texts):
        mine = [k for k in want if k[0] == d]
        if mine and all(want[k][0] for k in mine):
            assert d not in kept
        elif not any(want[k][0] for k in mine):
            assert kept[d]["text"] == t
        else:
            text = "\n".join(x for i, x in enumerate(t.split("\n")) if not want.get((d, i), (False,))[0])
            assert (kept[d]["text"], kept[d]["n_chars"]) == (text, len(text))
    assert line_dedup.drop_lines(docs).columns == docs.columns


def test_lines_edge_rows(spark):
    rows = [(1, "a b c\nd"), (1, "a b c\nd"), (None, "a b c"), (2, None), (3, "!\n?")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(line_dedup.summary(frame).collect(), key=str)
    assert [tuple(r) for r in got] == [(1, 1, 2, 0, 0), (1, 1, 2, 0, 0), (2, 2, 0, 0, 0), (3, 3, 0, 0, 0), (None, 1, 1, 1, 0)]
    assert line_dedup.summary(frame.limit(0)).collect() == []
    assert len(line_dedup.drop_lines(frame).collect()) == 4


def test_similar_lines_go_on_at_few_words(spark):
    """Near copies go on at the first words of common runs, not at each prefix word: one or two rows a set."""
    rows = [(i, " ".join(f"word{k}" for k in range(40)) + f" other{i % 6} more{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = line_dedup.lines(docs, line_dedup.rarity(docs))
    assert sets.select("h").distinct().count() == 30
    got = line_dedup._candidates(sets, line_dedup.SIMILARITY).groupBy("h").count().collect()
    assert len(got) == 30
    assert sum(r["count"] for r in got) <= 75


def test_long_lines_match_brute_force(spark):
    """Sets about and over ``LONG`` words, which have parities of their own, at similarities about 0.8."""
    rng = np.random.default_rng(5)
    texts = []
    for size in (50, 62, 66, 90, 200, 400):
        base = [f"w{x}" for x in rng.choice(3000, size, replace=False)]
        for change in (0, 0.05, 0.1, 0.11, 0.12, 0.2, 0.25):
            k = int(size * change)
            texts += [" ".join(base[k:] + [f"n{x}" for x in rng.integers(0, 3000, k)]), " ".join(base[k:])]
    lines = line_sets(texts)
    want = {d: sum(r != s and len(s & r) >= 0.8 * len(s | r) - 1e-9 for r in {r for _, _, r in lines}) for d, _, s in lines}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_links"] for r in line_dedup.summary(docs).collect()}
    assert got == want
    assert len({v for v in want.values()}) > 2


def removed(texts):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        grams = [b[i:i + 50] for i in range(len(b) - 49)]
        gone = np.zeros(len(b), bool)
        for i, g in enumerate(grams):
            if g in seen:
                gone[i:i + 50] = True
        seen.update(grams)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [2, lpf_dedup.GROUP])
def test_repeated_strings_match_brute_force(docs, texts, group):
    got = {r["doc_id"]: tuple(r)[1:] for r in lpf_dedup.dedup(docs, group).collect()}
    assert got == dict(enumerate(removed(texts)))


def test_repeated_strings_edge_rows(spark):
    long = "the quick brown fox jumps over the lazy dog and runs away from it all"
    rows = [(2, long), (2, long), (2, "x" + long), (1, "y" + long), (None, long + "z"), (None, long + "q"), (7, None)]
    got = sorted(lpf_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    n = len(long)
    assert [(r["doc_id"], r["n_removed"], r["n_spans"]) for r in got] == [
        (1, 0, 0), (2, n, 1), (2, n, 1), (2, n, 1), (7, 0, 0), (None, n, 1), (None, n, 1)]
    assert lpf_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_copy_leaves_the_other_rows_of_its_id(spark):
    long = "the quick brown fox jumps over the lazy dog and runs away from it all"
    new = "a text of its own that no document before it has, long enough to be missed"
    rows = [(1, long), (2, long), (2, "see " + new), (5, new + " again"), (None, long), (None, "x" + long + "y")]
    got = lpf_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n, m = len(long), len(new)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got), key=str) == sorted([
        (1, n, 0, 0), (2, n, n, 1), (2, m + 4, 0, 0), (5, m + 6, m, 1), (None, n, n, 1), (None, n + 2, n, 1)], key=str)


def test_previous_factors_of_a_small_text():
    rng = np.random.default_rng(0)
    parts = [rng.integers(97, 99, 120).astype(np.uint8) for _ in range(3)]
    parts.append(parts[0][30:100])
    data = np.concatenate(parts)
    at = np.cumsum([0] + [len(p) for p in parts])
    start = np.concatenate([np.arange(a, b - 49) for a, b in zip(at[:-1], at[1:])])
    ident = np.searchsorted(at, start, side="right") - 1
    got = lpf_dedup.previous_factors(data, start, ident)
    text = data.tobytes()
    want = [any(text[s:s + 50] == text[o:o + 50] for o, j in zip(start, ident) if j < i) for s, i in zip(start, ident)]
    assert got.tolist() == want and math.isclose(sum(want), 21)


def test_only_the_rarest_cells_leave_a_node(spark):
    rng = np.random.default_rng(5)
    common = rng.integers(1, 2**62, 400)
    sets = [np.unique(np.concatenate((common[rng.random(400) > 0.08], rng.integers(1, 2**62, 20)))).astype(np.uint64)
            for _ in range(60)]
    rows = [(bytes([i]), bytes([i % 3]), s.tobytes()) for i, s in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "content binary, root binary, cells binary").repartition(3)
    some = dart_minhash._prefixes(nodes, 0.8).count()
    assert 0 < some < 0.25 * sum(map(len, sets))
    got = {(bytes(r["a"])[0], bytes(r["b"])[0]) for r in dart_minhash._candidates(nodes, 0.8).collect()}
    similar = {(i, j) for i in range(60) for j in range(i) if i % 3 != j % 3
               and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert similar and similar <= got and all(i % 3 != j % 3 for i, j in got)


def test_suffixes_are_put_in_order_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(6)
    data = rng.integers(97, 99, 100_000).astype(np.uint8)
    start, ident = rng.integers(0, 100_000 - 50, 200_000), rng.integers(0, 1000, 200_000)
    tracemalloc.start()
    got = lpf_dedup.previous_factors(data, start, ident)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * len(start)
    least = {}
    texts = [data[s:s + 50].tobytes() for s in start]
    for t, i in zip(texts, ident):
        least[t] = min(least.get(t, i), i)
    assert got.tolist() == [i > least[t] for t, i in zip(texts, ident)]
