"""Embedding near-duplicates, the filter audit and collocations against brute force."""

import collections
import itertools
import random
import re

import numpy as np
import pytest

from apidrift.llm import collocations, embed_dedup, filter_audit
from apidrift.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, bits int, phrase string, hash string"
SMALL = "/root/testdata/sf0.001"


def docs_of(spark, rows, parts=4):
    full = [(i, t, lang, source, len(t or ""), "clash", 9, "clash", "clash") for i, t, lang, source in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


# ------------------------------------------------------------------ op11

VECS = "vec_id long, embedding array<float>, label int, cell string, node string, w int"


def vectors(seed=3, dim=12):
    """Random vectors, groups of near copies around the threshold, exact copies, and a hot group."""
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, 2):
        for v in rng.normal(size=(80, dim)):
            rows.append((v, label))
            for _ in range(rng.integers(0, 3)):
                rows.append((v + rng.normal(size=dim) * rng.uniform(0.05, 0.45), label))
            if rng.random() < 0.1:
                rows.append((v * 3, label))
    hot = rng.normal(size=dim)
    rows += [(hot + rng.normal(size=dim) * 0.16, 1) for _ in range(150)] + [(hot, 1)] * 20
    order = rng.permutation(len(rows))
    return [(i, [float(np.float32(x)) for x in rows[k][0]], rows[k][1]) for i, k in enumerate(order)]


def brute_links(rows, least=0.93):
    ids = [r[0] for r in rows]
    x = [None if r[1] is None or r[2] is None else np.array(r[1], float) for r in rows]
    x = [None if v is None or not len(v) or not np.isfinite(v).all() or not v.any() else v / np.linalg.norm(v) for v in x]
    near = [[j for j in range(len(rows)) if j != i and x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2]
             and len(x[i]) == len(x[j]) and x[i] @ x[j] >= least] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        some = [ids[j] for j in seen if ids[j] is not None]
        comp = min(some) if some else None
        out.append((ids[i], len(near[i]), comp, ids[i] is not None and ids[i] == comp))
    return sorted(out, key=str)


def got_links(spark, rows, **how):
    df = spark.createDataFrame([(*r, "clash", "clash", 7) for r in rows], VECS).repartition(3)
    return sorted((tuple(r) for r in embed_dedup.classes(df, **how).collect()), key=str)


def test_links_match_brute_force_with_the_exact_margin(spark):
    rows = vectors()
    assert got_links(spark, rows, margin=None, target=40, block=30) == brute_links(rows)


def test_links_found_with_the_usual_margin(spark):
    rows = vectors(8, 32)
    got, want = got_links(spark, rows, target=20, block=50), brute_links(rows)
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_a_hot_group_is_a_core(spark):
    """Near copies around a centre are counted without a product, and links into the core are found."""
    rng = np.random.default_rng(1)
    hot = rng.normal(size=24)
    far = [(i, [float(x) for x in rng.normal(size=24)], 0) for i in range(60)]
    near = [(100 + i, [float(x) for x in hot + rng.normal(size=24) * 0.1 * np.linalg.norm(hot) / 5], 0) for i in range(200)]
    rows = far + near + [(400, [float(x) for x in hot + rng.normal(size=24) * 0.3], 0)]
    assert got_links(spark, rows, target=100, block=16, per_centre=200) == brute_links(rows)


def test_links_edge_rows(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, one, 0), (1, one, 0), (None, one, 0), (2, one, None), (3, None, 0), (4, [], 0), (5, [0.0, 0.0, -0.0], 0),
            (6, [1.0, None, 2.0], 0), (7, [float("nan"), 1.0, 1.0], 0), (8, [float("inf"), 1.0, 1.0], 0),
            (9, [1.0, 2.0], 0), (10, [2.0, 4.0, 6.0], 0), (11, one, 1), (None, [9.0, -1.0, 0.0], 5), (12, [0.0, 1.0], 7),
            (13, [-0.0, 1.0], 7)]
    clean = [(i, None if v and any(x is None for x in v) else v, label) for i, v, label in rows]
    assert got_links(spark, rows) == brute_links(clean)
    assert got_links(spark, []) == []


def test_forest_spans_what_is_linked():
    rng = np.random.default_rng(2)
    for _ in range(30):
        hit = rng.random((12, 9)) < 0.12
        edges = embed_dedup.forest(hit)
        assert all(hit[r, c] for r, c in edges)
        root = list(range(21))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for r, c in edges:
            assert find(r) != find(12 + c)
            root[find(r)] = find(12 + c)
        assert all(find(r) == find(12 + c) for r, c in zip(*np.nonzero(hit), strict=True))


# ------------------------------------------------------------------ op12

def brute_audit(rows, labels):
    def fails(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return "".join(name for name, bad in zip("ABCDE", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            bool(re.search(r"[#$%&*|]", t)),
            i is not None and any(u == t and j is not None and j < i for j, u, _, _ in rows)), strict=True) if bad)

    rows = [(i, t or "", lang, s or "") for i, t, lang, s in rows]
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    out = []
    for part in {r[3] for r in rows}:
        own = [(r[0], fails(r[0], r[1])) for r in rows if r[3] == part]
        first = collections.Counter()
        lines = []
        for order in itertools.permutations("ABCDE"):
            for k, name in enumerate(order):
                before = set(order[:k])
                here = [i for i, f in own if name in f and not before & set(f)]
                first[name] += len(here)
                lines.append((part, "".join(order), k + 1, sum(not (before | {name}) & set(f) for _, f in own), len(here),
                              sum(name in f and bool(before & set(f)) for _, f in own), sum(f == name for _, f in own),
                              sum(i in good for i in here), sum(i in toxic for i in here), name))
        out += [(*line[:-1], first[line[-1]]) for line in lines]
    return sorted(out)


def test_audit_matches_brute_force(spark):
    rng = random.Random(4)
    bag = ["a", "b", "Caps", "WORD", "x#y", "é", "long-word", *[f"w{i}" for i in range(90)]]
    texts = [" ".join(rng.choices(bag[rng.choice([0, 4, 7]):], k=rng.choice([3, 48, 49, 50, 60, 90]))) for _ in range(60)]
    texts += ["", None, " \n\t", "A" * 40, "$", "x " * 3000]
    rows = [(i, rng.choice(texts), "en", rng.choice(["a", "b", None, ""])) for i in range(150)]
    rows += rows[:7] + [(None, texts[0], "en", "a"), (None, texts[0], "en", "a"), (500, texts[0], None, "c"), (500, "other", None, "c")]
    rows += [(1000 + i, "the same text for many", "en", "a") for i in range(80)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 200, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (500, 1, 0)]
    said = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = sorted(tuple(r) for r in filter_audit.audit(docs_of(spark, rows), said).collect())
    assert got == brute_audit(rows, labels)


def test_audit_salts_hot_texts(spark, monkeypatch):
    rows = [(i, "hot text" if i % 3 else f"text {i}", "en", "s") for i in range(300)]
    monkeypatch.setattr(filter_audit, "max", lambda a, b: 10, raising=False)
    docs = docs_of(spark, rows)
    marks = filter_audit._rows(docs).drop("text")
    got = filter_audit.repeated(filter_audit._rows(docs), marks)
    assert sorted(r["doc_id"] for r in got.collect()) == [i for i in range(2, 300) if i % 3]


def test_audit_of_nothing(spark):
    said = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs_of(spark, []), said).count() == 0


# ------------------------------------------------------------------ op13

def brute_phrases(rows, least=10, longest=3, most=2000, share=50):
    out = []
    by = collections.defaultdict(collections.Counter)
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for _, t, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(low)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    by["und" if lang is None else lang][tuple(w[i:i + m])] += 1
    for lang, f in by.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            if any(100 * b >= share * a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))
                   for q, b in cand.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def phrase_rows(seed=6):
    rng = random.Random(seed)
    fixed = ["New York City", "of the", "in the middle of", "état-major général", "x\x0by"]
    rows = []
    for i in range(160):
        w = []
        while len(w) < rng.choice([0, 5, 60, 200]):
            w += rng.choice(fixed).split(" ") if rng.random() < 0.2 else [f"w{int(rng.random() ** 2 * 40)}"]
            if rng.random() < 0.15:
                w[-1] += rng.choice([".", ",", ";\n", "\r\n", "!?", "\x0c"])
        rows.append((i, rng.choice([" ", "  ", " \t"]).join(w), rng.choice(["en", "fr", None, "und"]), "s"))
    return rows + [(900, None, "en", "s"), (901, "", "de", "s"), (902, "lonely words here", "de", "s"), (903, "\x00 \x00 " * 30, "nul", "s")]


def phrases(spark, rows, **how):
    return sorted(tuple(r) for r in collocations.mine(docs_of(spark, rows), **how).collect())


@pytest.mark.parametrize("how", [
    {},
    # tables too small for all words and pairs: the rest is counted as texts
    {"head": 12, "tile": 4, "dense": 3, "pending": 50},
    {"head": 60, "tile": 8, "dense": 1},
    {"head": 0},
])
def test_phrases_match_brute_force(spark, how):
    rows = phrase_rows()
    assert phrases(spark, rows, **how) == brute_phrases(rows)


def test_longer_phrases_and_other_limits(spark):
    rows = phrase_rows(7)
    got = phrases(spark, rows, least=6, longest=4, most=25, share=80, head=40, tile=8, dense=4)
    assert got == brute_phrases(rows, 6, 4, 25, 80)


def test_long_text_is_counted_in_blocks(spark, monkeypatch):
    import pyarrow as pa

    rows = phrase_rows(9)
    text = " ".join(t or "" for _, t, _, _ in rows)
    for size in (7, 100, 5000):
        parts = list(collocations.blocks(pa.array([text, "", "end"], pa.string()), size))
        assert b"".join(p.tobytes() for p in parts).decode() == re.sub("[A-Z]", lambda m: m[0].lower(), f"{text}\n\nend\n")
        got = sum((collocations.words_of(p)[0].to_pylist() for p in parts), [])
        assert got == [x.encode() for x in re.findall(r"[^\x20\x09-\x0D.,;:!?]+", text.lower())] + [b"end"]


def test_phrases_of_nothing(spark):
    assert phrases(spark, []) == []
    assert phrases(spark, [(1, None, None, None), (2, "one two three", "en", "s")]) == []


def test_products_past_64_bits(spark):
    big = 4_000_000_000
    rows = [("en", 1, "a", big, 10**10), ("en", 1, "b", big + 7, 10**10), ("en", 2, "a b", big - 1, 10**10)]
    df = spark.createDataFrame(rows, "lang string, size int, phrase string, f long, n long")
    (r,) = collocations.top(collocations.scored(df)).collect()
    assert r["score"] == 1000000 * (big - 1) ** 2 // (big * (big + 7))


def test_registered_queries_run(spark):
    assert QUERIES["op11_embed_kmeans"](spark, SMALL).columns == ["vec_id", "n_links", "component_id", "kept"]
    audit = QUERIES["op12_filter_audit"](spark, SMALL)
    assert audit.count() == 600 * spark.read.parquet(f"{SMALL}/documents.parquet").select("source").distinct().count()
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    assert sorted(tuple(r) for r in QUERIES["op13_collocations"](spark, SMALL).collect()) == brute_phrases(docs)
