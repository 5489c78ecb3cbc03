"""Main text of web pages by a style tree per host.

The pages of a host are merged into one tree: a node is a path of elements
with their classes.  A node has two distributions over the host's pages, of
the tag sequences of its children (its presentation) and of the texts
directly in it (its content).  Their entropies, to the base of the number of
pages that have the node, are 0 for what is the same on each of them and 1
for what is new on each; a node on fewer than ``PAGES`` pages counts as new.  A node's importance blends its own entropies with its children's,
which count less with every step down.  A branch is noise if its node and
all nodes in it have an importance below ``LEAST``.

From a page the tree's noise goes, and what is out by its element or its
names (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, comments).  Where a page marks its article, only the article's
blocks are kept.  Two pages may hold the same article, so the tree takes a
block from it only if its node, on ``MARKED`` pages at least, is noise by its
own presentation and its own content, and if ``PAGES`` pages have this text
there; an article that would lose all of its blocks keeps them.  Hosts with
fewer than ``PAGES`` pages have no tree.

Spark counts nodes, texts and shapes per host with partial sums, so a large
host costs as many rows as it has distinct ones; each host's tree, which has
a row for each path, is rolled up on its own, and its noise is joined to
the pages.

Defined cases: null html is empty; a page without text gives ""; a null url
is the host ""; repeated rows are pages of their own.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apidrift.llm.common import checkpoint
from apidrift.llm.html_blocks import blocks

PAGES = 8
MARKED = 16
LEAST = 0.5
CHILDREN = 0.9
DEEPEST = 40


def _number(x) -> int:
    return xxhash.xxh64_intdigest("\x00".join(x) if isinstance(x, tuple) else x) - 2**63


def _rows(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), "^[a-zA-Z][^:/?#]*://([^/?#]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


_FACTS = "host string, node long, parent long, kind string, value long, first long"


def _facts(rows: DataFrame) -> DataFrame:
    """Each page's distinct texts and shapes at each node, with 1 in ``first`` once for each node and kind."""
    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("host", "node", "parent", "kind", "value", "first")}
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                texts, shapes = blocks(html.as_py())
                seen = {(b.path[:DEEPEST], "text", _number(b.text)) for b in texts}
                seen |= {(p[:DEEPEST], "shape", _number(s)) for p, s in shapes}
                before = None
                for path, kind, value in sorted(seen):
                    for k, x in zip(out, (host, _number(path), _number(path[:-1]) if path else None, kind, value,
                                          int((path, kind) != before)), strict=True):
                        out[k].append(x)
                    before = path, kind
            yield pa.RecordBatch.from_pydict({"host": pa.array(out["host"], pa.string()),
                                              "node": pa.array(out["node"], pa.int64()),
                                              "parent": pa.array(out["parent"], pa.int64()),
                                              "kind": pa.array(out["kind"], pa.string()),
                                              "value": pa.array(out["value"], pa.int64()),
                                              "first": pa.array(out["first"], pa.int64())})

    return rows.select("host", "html").mapInArrow(run, _FACTS)


def importance(nodes: list[dict], children: float = CHILDREN) -> dict[int, float]:
    """Importance of each node of one host.

    nodes: of ``node``, ``parent``, ``text`` and ``shape`` (entropies, or
    None where the node has no such thing) and ``n`` (occurrences).
    """
    own, below, weight = {}, defaultdict(list), {}
    for r in nodes:
        parts = [x for x in (r["text"], r["shape"]) if x is not None]
        own[r["node"]] = sum(parts) / len(parts) if parts else None
        weight[r["node"]] = r["n"]
        if r["parent"] is not None and r["parent"] != r["node"]:
            below[r["parent"]].append(r["node"])
    done: dict[int, float] = {}
    for root in own:
        # children first, without recursion
        todo = [(root, False)]
        while todo:
            node, ready = todo.pop()
            if node in done:
                continue
            if not ready:
                todo.append((node, True))
                todo += [(c, False) for c in below[node] if c not in done]
                continue
            some = [c for c in below[node] if c in done]
            total = sum(weight[c] for c in some)
            mean = sum(weight[c] * done[c] for c in some) / total if total else None
            mine = own[node]
            done[node] = (mine if mean is None else mean) if mine is None or mean is None else (
                (1 - children) * mine + children * mean)
            if done[node] is None:
                done[node] = 1.0
    return done


def noisy(nodes: list[dict], least: float) -> list[int]:
    """Nodes that are less important than ``least``, and all nodes below them as well."""
    value = importance(nodes)
    parent = {r["node"]: r["parent"] for r in nodes}
    fine = set()
    for node, v in value.items():
        if v >= least:
            while node in parent and node not in fine:
                fine.add(node)
                node = parent[node]
    return sorted(set(value) - fine)


def noise(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """(host, noise, texts): numbers of the nodes of each host's noise, and of the texts that go from articles."""
    rows = _rows(pages)
    size = rows.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= PAGES)
    count = checkpoint(_facts(rows).groupBy("host", "node", "parent", "kind", "value").agg(
        F.count("*").alias("n"), F.sum("first").alias("first")))
    entropy = count.groupBy("host", "node", "parent", "kind").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.sum("first").alias("on"))
    # a node on a few pages says nothing
    entropy = entropy.join(size, "host", "left_semi").withColumn("entropy", F.when(
        F.col("on") >= PAGES, F.least(F.lit(1.0), (F.log("n") - F.col("nlogn") / F.col("n")) / F.log("on"))).otherwise(1.0))

    def roll(table: pa.Table) -> pa.Table:
        nodes: dict[int, dict] = {}
        for r in table.to_pylist():
            x = nodes.setdefault(r["node"], {"node": r["node"], "parent": r["parent"], "text": None, "shape": None,
                                             "n": 0, "on": 0})
            x[r["kind"]], x["n"] = r["entropy"], max(x["n"], r["n"])
            if r["kind"] == "text":
                x["on"] = r["on"]
        low = noisy(list(nodes.values()), least)
        own = [k for k in low if nodes[k]["on"] >= MARKED and all(
            nodes[k][x] is None or nodes[k][x] < least for x in ("text", "shape"))]
        return pa.table({"host": pa.array([table.column("host")[0].as_py()], pa.string()),
                         "noise": pa.array([low], pa.list_(pa.int64())), "own": pa.array([own], pa.list_(pa.int64()))})

    low = checkpoint(entropy.select("host", "node", "parent", "kind", "entropy", "n", "on")
                     .groupBy("host").applyInArrow(roll, "host string, noise array<long>, own array<long>"))
    same = count.where((F.col("kind") == "text") & (F.col("n") >= PAGES)).join(
        low.select("host", F.explode("own").alias("node")), ["host", "node"])
    same = same.groupBy("host").agg(F.collect_set(F.col("node").bitwiseXOR(F.col("value"))).alias("texts"))
    return low.select("host", "noise").join(same, "host", "left")


def main_text(html: str, low: frozenset = frozenset(), same: frozenset = frozenset()) -> str:
    """The article's blocks, one a line.

    low: nodes that go where no article is marked; same: texts at nodes that go from marked ones.
    """
    found, _ = blocks(html)
    marked = any(b.inside and not b.out for b in found)
    kept = [b for b in found if not b.out and (b.inside or not marked)]
    if marked and same:
        fine = [b for b in kept if _number(b.path[:DEEPEST]) ^ _number(b.text) not in same]
        kept = fine or kept
    elif low and not marked:
        kept = [b for b in kept if _number(b.path[:DEEPEST]) not in low]
    return "\n".join(b.text for b in kept)


def extract(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    low = checkpoint(noise(pages, least))
    rows = _rows(pages).join(low, "host", "left")

    def run(batches):
        kept: dict[tuple, tuple] = {}
        for batch in batches:
            text = []
            for html, nodes, texts in zip(batch.column("html"), batch.column("noise").to_pylist(),
                                          batch.column("texts").to_pylist(), strict=True):
                key = tuple(nodes or ()), tuple(texts or ())
                if key not in kept:
                    kept.clear()
                    kept[key] = tuple(map(frozenset, key))
                text.append(main_text(html.as_py(), *kept[key]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()),
                 pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "noise", "texts").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
