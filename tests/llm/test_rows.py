"""Operators on single documents and pages against brute force, round trips and held-out accuracy."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from apidrift.llm import decontam, divergence, langid, packing, quality_fm, style_tree, token_rollup
from apidrift.llm.html_blocks import blocks
from apidrift.llm.tokens import Encoder, default_paths

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "é", "\n", "x  y", "tab\there", "<|endoftext|> text", "word " * 3000, "ÀÉ b", "1 2 3 !"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "s", None, 0.5, "x") for i, t in enumerate(ODD)]
    rows += [(None, "null id", None, None, 1, None, None), rows[3], rows[3]]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, score double, predicted string")


# language


def test_forward_sums_all_segmentations():
    vocabulary = langid.Vocabulary.of(langid.default_vocabulary())
    p = np.random.default_rng(0).random((len(vocabulary), 3))
    number = {x: i + 1 for i, x in enumerate(vocabulary.pieces)}

    def brute(word):
        word = langid.MARK + word
        total = [np.ones(3)] + [np.zeros(3) for _ in word]
        for e in range(1, len(word) + 1):
            for k in range(1, e + 1):
                n = number.get(word[e - k:e])
                if n or k == 1:
                    total[e] = total[e] + total[e - k] * p[n or 0]
        return np.log(total[-1])

    text, start, size, row = langid._words(["hello wörld élan x", "", "123 ab" + "c" * 70])
    words = ["hello", "wörld", "élan", "x", "ab" + "c" * 30, "c" * 32, "c" * 8]
    got = langid.word_probabilities(text, start, size, vocabulary, p)
    assert row.tolist() == [0, 0, 0, 0, 2, 2, 2]
    assert np.allclose(got, [brute(w) for w in words])
    scorer = langid.Scorer(vocabulary, p)
    for _ in range(2):  # the second time from the table
        total, n = scorer(["hello wörld hello", "", "x"])
        assert np.allclose(total, [2 * brute("hello") + brute("wörld"), np.zeros(3), brute("x")], rtol=1e-5)
        assert n.tolist() == [3, 0, 1]


def test_expectation_adds_up():
    vocabulary = langid.Vocabulary.of(langid.default_vocabulary())
    p = np.random.default_rng(1).random((len(vocabulary), 2))
    text, start, size, _ = langid._words(["hello there"])
    counts = np.array([[2.0, 0.0], [1.0, 3.0]])
    got = langid.expected_counts(text, start, size, vocabulary, p, counts)
    width = np.array([1] + [len(x) for x in vocabulary.pieces])
    assert np.allclose((got * width[:, None]).sum(axis=0), (counts * size[:, None]).sum(axis=0))


def test_language_held_out(documents, odd):
    model = langid.learn(documents.where(~langid.held_out()))
    assert model[0] == ["de", "en", "es", "fr"] and np.allclose(model[1].sum(axis=0), 1)
    found = langid.predict(documents, *model).join(documents.select("doc_id", "lang"), "doc_id")
    rows = found.where(langid.held_out()).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    got = collections.defaultdict(list)
    for r in langid.predict(odd, *model).collect():
        got[r["doc_id"]].append((r["lang_pred"], r["score"]))
    assert len(got[3]) == 3 and len(set(got[3])) == 1
    for i, t in enumerate(ODD):
        letters = any(c.isalpha() for c in t or "")
        assert (got[i][0] == ("und", 0.0)) == (not letters) and 0 <= got[i][0][1] <= 1
    none = langid.learn(odd.where("lang = 'none'"))
    assert none[0] == [] and {r["lang_pred"] for r in langid.predict(odd, *none).collect()} == {"und"}
    assert langid.predict(odd.limit(0), *model).collect() == []


# decontamination


def _index(items):
    df, rows = collections.Counter(), []
    for i, text in enumerate(items):
        w = regex.findall("[0-9a-z\x80-\U0010ffff]+", text.lower())
        df.update(set(w))
        rows.append({"item_id": i, "text_key": i, "segment": 0, "words": w, "n_question": len(w)})
    for r in rows:
        r["df"] = {w: df[w] for w in r["words"]}
    return decontam.Index(rows, len(rows), sum(len(r["words"]) for r in rows) / len(rows))


def test_wand_returns_all_above_the_threshold():
    rng = random.Random(2)
    index = _index([" ".join(f"w{int(rng.random() ** 2 * 60)}" for _ in range(rng.randint(5, 30))) for _ in range(60)])
    for _ in range(200):
        terms = rng.sample(range(len(index.terms)), rng.randint(1, 25))
        least = rng.choice([0.05, 0.2, 0.5])
        score = collections.Counter()
        for t in terms:
            for s, w in index.lists[t]:
                score[s] += w
        got = dict(index.search(sorted(terms), least))
        want = {s: x for s, x in score.items() if x >= least}
        assert {s for s, x in want.items() if x > least + 1e-6} <= set(got) <= {s for s, x in want.items() if x > least - 1e-6}
        assert all(math.isclose(got[s], score[s]) for s in got)


def test_decontamination(spark, documents, odd):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.matches(documents, items).collect()}
    texts = {r["doc_id"]: r["text"].lower() for r in documents.collect()}
    inside = {(d, i["item_id"]) for i in items.collect() for d, t in texts.items() if i["text"].lower() in t}
    assert inside and got == inside
    clean = decontam.drop_contaminated(documents, items)
    assert clean.columns == documents.columns
    assert {r["doc_id"] for r in clean.collect()} == set(texts) - {d for d, _ in inside}
    assert decontam.drop_contaminated(odd, items).count() == odd.count()
    assert decontam.matches(documents, items.limit(0)).collect() == []
    assert decontam.matches(documents.limit(0), items).collect() == []


def test_question_and_answer_must_both_be_there(spark):
    question = "which of the seven rivers in the northern province carries most water in a dry summer"
    answer = "it is the river that the old people of the valley call the grey one"
    items = spark.createDataFrame([(1, f"{question}\n{answer}"), (1, f"{question}\n{answer}"), (2, None), (3, "four words are few")],
                                  "item_id long, text string")
    fill = " ".join(f"filler{i}" for i in range(150))
    docs = spark.createDataFrame(
        [(1, f"{fill} {question.upper()}, {answer}. {fill}"), (2, f"{fill} {question} {fill}"),
         (3, f"{fill} {answer} {fill}"), (4, "four words are few"), (5, f"{fill} {question} {fill} {answer}")],
        "doc_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontam.matches(docs, items).collect()]
    # an item of four words is one run of four
    assert (4, 3) in got
    got.remove((4, 3))
    assert got[0] == (1, 1) and {d for d, _ in got} <= {1, 5}


def test_short_parts_are_asked_for(spark):
    fill = " ".join(f"filler{i}" for i in range(150))
    items = spark.createDataFrame([(1, "who is it\nthe grey one"), (2, "what is the capital of the northern province today\nAmbervale"),
                                   (3, "one more question without any answer here"), (4, "\n"), (5, "a\nb")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, f"{fill} Who is it\nThe grey one. {fill}"), (2, f"{fill} who is it the grey {fill}"),
         (3, f"{fill} what is the capital of the northern province today? Ambervale! {fill}"),
         (4, f"{fill} what is the capital of the northern province today? Elsewhere. {fill}"),
         (5, f"{fill} one more question without any answer here {fill}"), (6, fill)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.matches(docs, items).collect())
    assert got == [(1, 1), (3, 2), (5, 3)]
    assert sorted(r["doc_id"] for r in decontam.drop_contaminated(docs, items).collect()) == [2, 4, 6]


def test_question_and_answer_of_a_long_item_in_other_segments(spark):
    rng = random.Random(5)
    question = " ".join(f"q{rng.randrange(10**6)}" for _ in range(150))
    answer = " ".join(f"a{rng.randrange(10**6)}" for _ in range(70))
    fill = " ".join(f"filler{i}" for i in range(150))
    items = spark.createDataFrame([(1, f"{question}\n{answer}")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{question} {fill} {answer}"), (2, f"{fill} {question}"), (3, answer),
                                  (4, " ".join(answer.split()[-8:]))], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.matches(docs, items).collect()] == [(1, 1)]


def test_sums_for_some_halves_at_a_time(monkeypatch):
    rng = random.Random(7)
    items = [" ".join(f"w{int(rng.random() ** 2 * 80)}" for _ in range(rng.randint(8, 40))) for _ in range(30)]
    index = _index(items)
    text = " ".join(" ".join([f"w{rng.randrange(80)}" for _ in range(rng.randint(0, 200))] + [rng.choice(items)]) for _ in range(60))
    column = pa.array([text, "", items[0], text[::-1]])
    want = index.hits(column)
    assert want
    for n in (1, 2, 7):
        monkeypatch.setattr(decontam, "HALVES", n)
        assert index.hits(column) == want


def test_long_items_are_found_by_their_segments(spark):
    rng = random.Random(4)
    item = " ".join(f"t{rng.randrange(10**6)}" for _ in range(400))
    docs = spark.createDataFrame([(1, f"before {item[900:1900]} after"), (2, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.matches(docs, items).collect()] == [(1, 9)]


# quality rules


# few bits: windows that share a hash and differ, and texts with more words than a place can tell
@pytest.mark.parametrize("bits", [None, (23, 2), (5, 39), (6, 3)])
def test_divergence_counts(documents, odd, monkeypatch, bits):
    if bits:
        monkeypatch.setattr(divergence, "_POSITION", bits[0])
        monkeypatch.setattr(divergence, "_HASH", bits[1])
    both = documents.select("doc_id", "text", "lang").unionByName(
        odd.select((F.col("doc_id") + 10**6).alias("doc_id"), "text", "lang"))
    rows = both.collect()
    got = {r["doc_id"]: r for r in divergence.rules(both).collect()}
    for r in rows:
        t = r["text"] or ""
        w = [x for x in regex.split(r"[\x20\x09-\x0D]+", t) if x]
        lines = [x for x in t.split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
        c = collections.Counter(zip(w, w[1:], w[2:]))
        again = {k for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
        g = got[r["doc_id"]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(regex.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert g["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (g["base_failed"] and g["kept"])
    assert divergence.rules(both.limit(0)).collect() == []


def test_divergence_is_jensen_shannon(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat and the dog ran. " * 3 + " ".join(f"n{i}x" for i in range(120)), "en"),
                                  (2, "le chat et le chien. " * 30, "fr"), (3, "A!! B## " * 60, None)],
                                 "doc_id long, text string, lang string")
    chars, words = divergence.references(docs, 4)
    got = {r["doc_id"]: r for r in divergence.judge(docs, chars, words).collect()}

    def distance(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q)]
        return math.sqrt(sum(x * math.log2(x / y) / 2 for v in (p, q) for x, y in zip(v, m) if x))

    for r in docs.collect():
        w = r["text"].lower().split()
        best = []
        for ref in words.values():
            p = [w.count(x) / len(w) for x in ref]
            q = [s for s, _ in ref.values()]
            best.append(distance([*p, 1 - sum(p)], [*q, 1 - sum(q)]))
        assert math.isclose(got[r["doc_id"]]["word_distance"], min(best), abs_tol=1e-6)
        own = [len(regex.findall(f"[{c}]", r["text"])) / len(r["text"]) for c in divergence.CLASSES.values()]
        best = [distance([*own, 1 - sum(own)], q) for q in chars.values()]
        assert math.isclose(got[r["doc_id"]]["character_distance"], min(best), abs_tol=1e-6)


def test_letters_swapped_for_odd_marks_fail(spark):
    rng = random.Random(6)

    def text():
        return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(60)) + "."

    good = [text() for _ in range(20)]
    marks = str.maketrans("etaoinshrdlu", "_[]{}@~^=+/\\")
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good)] + [(99, good[0].translate(marks), None)],
                                 "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in divergence.rules(docs).collect()}
    assert all(got[i]["kept"] for i in range(20))
    assert got[99]["character_distance"] > divergence.CHARACTER_LIMIT and not got[99]["kept"]


# the machine is the same however the data are partitioned


def test_quality_is_the_same_for_any_partitions(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["good", "words", "here", "and", "there"] if i % 2 else ["BUY", "now", "$$$", "click"], k=rng.randint(5, 60)))
             for i in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "another text of the same id"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(5, 0), (6, None), (None, 1)], "doc_id long, quality int")
    got = [quality_fm.learn(docs.repartition(n), labels.repartition(n)).pack() for n in (1, 4, 37)]
    assert got[0] == got[1] == got[2]


def test_pieces_of_any_length_count():
    vocabulary = langid.Vocabulary.of(langid.default_vocabulary())
    longest = max(vocabulary.pieces, key=len)
    assert vocabulary.widest == len(longest) > 12
    word = longest.removeprefix(langid.MARK)
    text, start, size, _ = langid._words([word])
    number = vocabulary.pieces.index(longest) + 1
    p = np.full((len(vocabulary), 2), 1e-9)
    p[number, 1] = 0.5
    got = langid.word_probabilities(text, start, size, vocabulary, p)
    if longest.startswith(langid.MARK):
        assert got[0, 1] == pytest.approx(math.log(0.5), abs=1e-3)
    else:
        assert got[0, 1] > got[0, 0]


# pages


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header>
<nav><ul><li><a href=/>Home</a><li>More</ul></nav><div class="cookie-notice"><p>We use cookies</p></div>
<main><article><header><h1>Head &amp; line</h1></header><p>One <b>two<br>three &eacute;<p>four&nbsp;five
six<script>var a="</p>";</script> seven</p><aside>Side</aside><form><input><p>Mail</p></form><ul><li>item a<li>item b</ul>
<div class="adBox">Buy</div></article><section id="comments"><p>Nice!</p></section></main><footer><p>&copy; x</footer></body>"""


def test_article_text():
    assert style_tree.main_text(PAGE) == "Head & line\nOne two three é\nfour five six\nseven\nitem a\nitem b"
    for html in ("", "<", "<<p", "<p", "text", "<script>", "<!-- x", "</b></p>", "<a title='>", "<p>" * 3000 + "x", "&#x0;&bogus;"):
        blocks(html)
    assert style_tree.main_text("plain <i>text</i>") == "plain text"


def test_tree_removes_what_a_host_repeats(spark):
    rng = random.Random(1)

    def page(i, j):
        text = " ".join(f"{rng.randrange(10**9):x}" for _ in range(12))
        return (i, f"http://h{j}.example/{i}", f"<body><div><span>Menu entry {i % 2}</span></div><div class=t><p>{text}</p></div>"
                f"<div class=b><p>Same on all</p></div>", text)

    pages = [page(i, 1) for i in range(30)] + [page(i, 2) for i in range(30, 33)]
    rows = [p[:3] for p in pages] + [(99, None, None), (99, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = collections.defaultdict(list)
    for r in style_tree.extract(frame).collect():
        assert r["n_chars"] == len(r["text"])
        got[r["page_id"]].append(r["text"])
    for i, _, _, text in pages[:30]:
        assert got[i] == [text]
    for i, _, _, text in pages[30:]:  # too few pages for a tree
        assert got[i] == [f"Menu entry {i % 2}\n{text}\nSame on all"]
    assert got[99] == ["", ""]
    assert style_tree.extract(frame.limit(0)).collect() == []


def test_templates_on_few_of_a_hosts_pages(spark):
    rng = random.Random(2)

    def page(i):
        text = " ".join(f"{rng.randrange(10**9):x}" for _ in range(12))
        return (i, f"http://h.example/{i}", f"<body><div class=k{i % 6}><div class=m>Menu {i % 6}</div><p>{text}</p></div>", text)

    pages = [page(i) for i in range(120)]
    frame = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in style_tree.extract(frame).collect()}
    assert got == {p[0]: p[3] for p in pages}


def test_tree_decides_inside_articles(spark):
    rng = random.Random(3)

    def text():
        return " ".join(f"{rng.randrange(10**9):x}" for _ in range(12))

    shared, mirror = text(), text()  # an article on several pages; one page on all of a host's urls

    def page(i):
        body = shared if i < 10 else text()
        own = f"\n{text()}" if i % 5 == 0 else ""  # a text of its own where others have the notice
        note = own.strip() or "Tell your friends"
        return (i, f"http://h.example/{i}", f"<body><article><p>{body}</p><div class=x><span>{note}</span></div></article>",
                body + own)

    pages = [page(i) for i in range(60)]
    pages += [(i, f"http://m.example/{i}", f"<main><p>{mirror}</p></main>", mirror) for i in range(60, 90)]
    frame = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in style_tree.extract(frame).collect()}
    assert got == {p[0]: p[3] for p in pages}


# quality classifier


def test_pairs_by_the_square_of_sums():
    rng = np.random.default_rng(5)
    m = quality_fm.Machine(0.3)
    m.w = rng.normal(size=quality_fm.N_FEATURES).astype(np.float32)
    m.v = rng.normal(size=m.v.shape).astype(np.float32)
    row, number, value = quality_fm.features(pa.array(["a few words of text", "", "Some OTHER words!"]))
    got = m.forward(row, number, value)[0]
    for r in range(3):
        x, n = value[row == r], number[row == r]
        pairs = sum(float(m.v[n[i]] @ m.v[n[j]]) * x[i] * x[j] for i in range(len(n)) for j in range(i))
        assert math.isclose(got[r], 0.3 + float((m.w[n] * x).sum()) + pairs, rel_tol=1e-4, abs_tol=1e-3)


def test_quality(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    machine = quality_fm.learn(docs, labels.where(~quality_fm.held_out()))
    rows = quality_fm.score(docs, machine).join(labels, "doc_id").where(quality_fm.held_out()).collect()
    assert sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in rows) >= 0.95 * len(rows)
    got = quality_fm.score(odd.drop("score", "predicted"), machine).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    kept = quality_fm.drop_low_quality(odd, machine)
    assert kept.columns == odd.columns and kept.count() == sum(r["predicted"] for r in got)
    assert quality_fm.learn(docs, labels.limit(0)) is None
    assert {r["score"] for r in quality_fm.score(odd.drop("score"), None).collect()} == {0.5}


# tokens


def test_ids_are_the_tokenizers(documents):
    encoder = Encoder(*default_paths())
    texts = [r["text"] for r in documents.limit(60).collect()] + [t for t in ODD if t is not None]
    texts += ["it's  a　b", "x\r\ny", " lead", "trail ", "a\x1cb c", "don't 'll we'Ve", "12345 ½ ²", "日本 語"]
    for t in texts:
        assert np.frombuffer(encoder.ids(t), "<u4").tolist() == encoder.whole.encode(t, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_bins(lengths):
    bins = packing.best_two_fit(lengths, 40)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(0 < sum(lengths[i] for i in b) <= 40 for b in bins)


def test_packing(documents, odd):
    encoder = Encoder(*default_paths())
    for frame, group in ((documents, packing.GROUP_PIECES), (documents, 50), (odd, 10**6)):
        rows = packing.pack(frame, group_pieces=group).collect()
        want = collections.Counter()
        for r in frame.collect():
            data = encoder.ids(r["text"] or "") + bytes(4)
            n, start, piece = len(data) // 4, 0, 0
            while start < n:
                size = (n - start) % 2048 or 2048 if piece == 0 else 2048
                want[r["doc_id"], piece, start, size, zlib.crc32(data[4 * start:4 * (start + size)])] += 1
                start, piece = start + size, piece + 1
        assert collections.Counter((r[0], r[1], r[2], r[3], r[4]) for r in rows) == want
        places = collections.defaultdict(list)
        for r in rows:
            places[r["sequence_id"]].append((r["offset"], r["length"]))
        for p in places.values():
            p.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and p[0][0] == 0 and sum(p[-1]) <= 2048
        if group == packing.GROUP_PIECES:
            assert len(places) <= 1.01 * sum(r["length"] for r in rows) / 2048 + 1
    assert packing.pack(documents.limit(0)).collect() == []


def test_rollup(spark, tmp_path, odd):
    shape = "change string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"
    roll = token_rollup.TokenRollup(spark, f"file://{tmp_path}/roll")
    assert roll.totals().collect() == []

    def changes(*rows):
        return spark.createDataFrame(rows, shape)

    def totals():
        return {tuple(r)[:3]: tuple(r)[3:] for r in roll.totals().collect()}

    first = changes(("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None),
                    ("insert", None, None, "v1", None, None), ("insert", "b", "en", "v1", 7, None))
    assert roll.commit("1", first) and not roll.commit("1", first)
    assert totals() == {("a", "en", "v1"): (2, 15), (None, None, "v1"): (1, 0), ("b", "en", "v1"): (1, 7)}
    assert roll.commit("2", changes(("revise", "a", "en", "v1", 12, 10), ("delete", "b", "en", "v1", 7, None)))
    assert totals() == {("a", "en", "v1"): (2, 17), (None, None, "v1"): (1, 0)}
    roll.compact()
    assert not roll.commit("1", first) and totals()["a", "en", "v1"] == (2, 17)
    assert roll.commit("3", changes(("delete", "a", "en", "v1", 5, None)))
    roll.compact()
    assert totals() == {("a", "en", "v1"): (1, 12), (None, None, "v1"): (1, 0)}
    with pytest.raises(Exception, match="unknown kind"):
        roll.commit("4", changes(("moved", "a", "en", "v1", 5, None)))
    assert totals()["a", "en", "v1"] == (1, 12)
    encoder = Encoder(*default_paths())
    for r in token_rollup.count_tokens(odd).collect():
        if r["doc_id"] is not None:
            assert r["n_tokens"] == len(encoder.ids(ODD[r["doc_id"]] or "")) // 4
