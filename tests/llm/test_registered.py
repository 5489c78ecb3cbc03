"""Registered queries against brute force on whole tables of the smallest size."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
import regex
import tokenizers

from apidrift.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


@pytest.fixture(scope="module")
def ids_of():
    import public_tokenizers

    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids


def rows(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, SF).collect()]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_op1(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op1_langid")}
    assert set(got) == {d for d, *_ in docs} and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == held(d) for d, r in got.items())
    known = [(got[d]["lang_pred"], lang) for d, text, lang, _ in docs if lang and held(d) and regex.search(r"\p{L}", text or "")]
    assert sum(a == b for a, b in known) >= 0.95 * len(known)


def test_op2(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = {(d, i["item_id"]) for d, text, *_ in docs for i in items if i["text"].strip() and i["text"].lower() in (text or "").lower()}
    got = {(r["doc_id"], r["item_id"]) for r in rows(spark, "op2_decontaminate")}
    assert want <= got and len(got - want) <= 0.2 * len(want) + 1


def test_op4(spark, docs):
    texts = sorted((d, (text or "").encode()) for d, text, *_ in docs)
    first: dict[bytes, int] = {}
    want = {}
    for d, data in texts:
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 49):
            if first.get(data[i:i + 50], d) < d:
                gone[i:i + 50] = True
        for i in range(len(data) - 49):
            first.setdefault(data[i:i + 50], d)
        spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        want[d] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(spark, "op4_lpf_dedup")}
    assert got == want


def test_op5(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    got = rows(spark, "op5_site_style_tree")
    assert sorted((r["page_id"], r["url"]) for r in got) == sorted(map(tuple, pages))
    assert all(r["n_chars"] == len(r["text"]) for r in got) and sum(bool(r["text"]) for r in got) >= 0.9 * len(got)


def test_op6(spark):
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = rows(spark, "op6_quality_fm")
    assert all(r["held_out"] == held(r["doc_id"]) and r["predicted"] == (r["score"] >= 0.7) for r in got)
    known = [((r["score"] >= 0.5), quality[r["doc_id"]] == 1) for r in got if r["held_out"] and r["doc_id"] in quality]
    assert known and sum(a == b for a, b in known) >= 0.9 * len(known)


def test_op7(spark, docs, ids_of):
    want = collections.defaultdict(lambda: [0, 0])
    for _, text, lang, source in docs:
        if (text or "").strip(" "):
            want[source, lang][0] += 1
            want[source, lang][1] += len(ids_of(text))
    got = {(r["source"], r["lang"]): [r["n_docs"], r["n_tokens"]] for r in rows(spark, "op7_token_rollup")}
    assert got == dict(want)


def test_op8(spark, docs, ids_of):
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in rows(spark, "op8_best_two_fit"):
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == {d for d, *_ in docs}
    total = 0
    for d, text, *_ in docs:
        ids = np.array([*ids_of(text), 0], "<u4")
        own = sorted(pieces[d], key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(own):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            assert r["length"] == 2048 or k == 0 or len(own) == 1 or k == len(own) - 1
            at += r["length"]
        assert at == len(ids) and (len(own) == 1) == (len(ids) <= 2048)
        total += at
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    # nearly as few as there can be
    assert len(sequences) <= 1.02 * -(-total // 2048) + 1


def test_op9(spark, docs):
    def shingles(text):
        w = regex.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
        return collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()

    s = [(d, shingles(text)) for d, text, *_ in sorted(docs)]
    root = {d: d for d, _ in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, a) in enumerate(s):
        for e, b in s[:i]:
            if a and b and (inter := sum((a & b).values())) and inter >= 0.8 * sum((a | b).values()) - 1e-9:
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in rows(spark, "op9_dart_minhash")}
    assert got == {d: (find(d), find(d) == d) for d, _ in s}
