"""Registered queries of this subpackage: (spark, sf_dir) -> DataFrame.

Each reads its whole table and calls one operator with production
parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apidrift.llm import (collocations, dart_minhash, decontam, divergence, embed_dedup, filter_audit, langid, line_dedup, lpf_dedup,
                          oracles, packing, quality_fm, style_tree, token_rollup)
from apidrift.llm.common import table
from apidrift.session import shared_path


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(~langid.held_out()))
    found = langid.predict(docs, *model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents: pairs of ids with score and overlaps."""
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the divergence rules for every document."""
    found = divergence.rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept")


def op4_lpf_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to earlier ones that share 50 bytes."""
    return lpf_dedup.dedup(table(spark, sf_dir, "documents"))


def op5_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return style_tree.extract(table(spark, sf_dir, "pages"))


def quality_machine(spark: SparkSession, sf_dir: str) -> quality_fm.Machine | None:
    """The quality classifier, learned from the labels of rows that aren't held out."""
    labels = table(spark, sf_dir, "labels")
    return quality_fm.learn(table(spark, sf_dir, "documents"), labels.where(~quality_fm.held_out()))


def op6_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    found = quality_fm.score(docs, quality_machine(spark, sf_dir))
    return found.select("doc_id", quality_fm.held_out().alias("held_out"), "score", "predicted")


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals by source, language and tokenizer after three batches.

    Every document comes in with a count estimated from its length, every
    count is then revised to the tokenizer's, and blank documents go out.
    The second batch is sent twice, as after a lost driver.
    """
    docs = table(spark, sf_dir, "documents")
    name = F.lit("byte_bpe_50k").alias("tokenizer")
    none = F.lit(None).cast("long")
    estimate = F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4)
    rollup = token_rollup.TokenRollup(spark, shared_path(spark, "token_rollup"))
    rollup.commit("0000-estimate", docs.select(
        "source", "lang", name, F.lit("insert").alias("change"), estimate.alias("n_tokens"),
        none.alias("old_tokens")))
    counted = token_rollup.count_tokens(docs.withColumn("estimate", estimate), keep=["estimate"])
    revised = counted.select("source", "lang", name, F.lit("revise").alias("change"), "n_tokens",
                             F.col("estimate").alias("old_tokens"))
    for _ in range(2):
        rollup.commit("0001-count", revised)
    blank = docs.where(F.trim(F.coalesce("text", F.lit(""))) == "")
    rollup.commit("0002-blank", token_rollup.count_tokens(blank).select(
        "source", "lang", name, F.lit("delete").alias("change"), "n_tokens", none.alias("old_tokens")))
    return rollup.totals()


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of every document, and whether it is the one kept."""
    found = dart_minhash.classes(table(spark, sf_dir, "documents"))
    doc_id = F.when(F.col("id") < 2**63 - 1, F.col("id")).alias("doc_id")
    return found.select(doc_id, "class_id", "kept")


def op10_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that match an earlier line."""
    return line_dedup.summary(table(spark, sf_dir, "documents"))


def op11_embed_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector, and whether it stands for its component."""
    return embed_dedup.classes(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes at each step of each order, by source."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language."""
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_langid": op1_langid,
    "op2_decontaminate": op2_decontaminate,
    "op3_divergence": op3_divergence,
    "op4_lpf_dedup": op4_lpf_dedup,
    "op5_site_style_tree": op5_site_style_tree,
    "op6_quality_fm": op6_quality_fm,
    "op7_token_rollup": op7_token_rollup,
    "op8_best_two_fit": op8_best_two_fit,
    "op9_dart_minhash": op9_dart_minhash,
    "op10_line_join": op10_line_join,
    "op11_embed_kmeans": op11_embed_kmeans,
    "op12_filter_audit": op12_filter_audit,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {"op3_divergence": oracles.OP3_DIVERGENCE, "op10_line_join": oracles.OP10_LINE_JOIN,
                           "op11_embed_kmeans": oracles.OP11_EMBED_KMEANS, "op12_filter_audit": oracles.OP12_FILTER_AUDIT,
                           "op13_collocations": oracles.OP13_COLLOCATIONS}
