"""The stages of the corpus pipeline, each against a brute-force version on its own input."""

import collections
import zlib

import corpus_pipeline
from test_pairs import classes, line_sets

SF = "/root/testdata/sf0.001"


def brute_lines(texts):
    lines = line_sets(texts)
    first = {}
    for d, i, s in lines:
        first.setdefault(s, (d, i))
    sets = list(first)
    earliest = {s: min(first[r] for r in sets if len(s & r) >= 0.8 * len(s | r) - 1e-9) for s in sets}
    gone = {(d, i) for d, i, s in lines if earliest[s] < (d, i)}
    out = {}
    for d, t in enumerate(texts):
        mine = [i for e, i, _ in lines if e == d]
        if not mine or any((d, i) not in gone for i in mine):
            out[d] = "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = seen[name] = docs.collect()
        if name == "pack":
            break
        assert docs.columns == columns and len({r["doc_id"] for r in rows}) == len(rows)
        after = {r["doc_id"]: r["text"] for r in rows}
        ids = sorted(before)
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            known = [d for d in before if d in labels and zlib.crc32(str(d).encode()) % 4 == 2]
            assert sum((d in after) == (labels[d] == 1) for d in known) >= 0.85 * len(known)
            assert all(after[d] == before[d] for d in after)
        elif name == "line_dedup":
            want = brute_lines([before[d] for d in ids])
            assert after == {ids[k]: t for k, t in want.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        elif name == "near_duplicates":
            want = classes([before[d] for d in ids])
            assert after == {ids[k]: before[ids[k]] for k in set(want)}
        elif name == "decontaminate":
            items = [r["text"].lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(after) == {d for d in before if not any(i in before[d].lower() for i in items)}
    sizes = collections.Counter()
    for r in seen["pack"]:
        sizes[r["sequence_id"]] += r["length"]
    assert max(sizes.values()) <= 2048 and {r["doc_id"] for r in seen["pack"]} == {r["doc_id"] for r in seen["decontaminate"]}


def test_odd_columns_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame(
        [(1, "a b c d e f g\nshort", "en", "s", 3, 0.1, "h", [1], {"n": 1}), (None, None, None, None, None, None, None, None, None),
         (2, "", "en", "s", 0, 0.2, "g", [], {})],
        "doc_id long, text string, lang string, source string, n_chars long, score double, h string, "
        "bands array<int>, `odd name.x` map<string, int>")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            path = f"{tmp_path}/{name}{frame is docs}"
            stage(spark, frame, SF).write.parquet(path)
            got = spark.read.parquet(path)
            assert name == "pack" or got.columns == docs.columns
            assert got.count() <= 3
