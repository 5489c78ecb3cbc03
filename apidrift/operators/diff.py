"""Catalog diff (D1-D6): added, deleted, modified A/B, in one outer join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apidrift.operators.signatures import compare_code, params_of

KEYS = ["lib", "kind", "api_path"]

# Folder label of each change class.
CATEGORY = {
    "added": "Added_API",
    "deleted": "Deleted_API",
    "modified_A": "Modified_API_A",
    "modified_B": "Modified_API_B",
}


def split_catalog(catalog: DataFrame, old_version: str, new_version: str):
    """(old, new) sides of a T2 catalog holding both versions."""
    cols = KEYS + ["signature", "doc"]
    old = catalog.where(F.col("version") == old_version).select(*cols)
    new = catalog.where(F.col("version") == new_version).select(*cols)
    return old, new


def api_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per API in either version with its change class.

    One full outer join on (lib, kind, api_path), the only shuffle. Pairs
    whose signature and doc are equal are never parsed; the others are
    parsed in the same stage (Arrow batches) and compared by one Catalyst
    expression.
    """
    o = old.select(*KEYS, F.col("signature").alias("old_signature"),
                   F.col("doc").alias("old_doc"), F.lit(True).alias("_in_old"))
    n = new.select(*KEYS, F.col("signature").alias("new_signature"),
                   F.col("doc").alias("new_doc"), F.lit(True).alias("_in_new"))
    j = o.join(n, KEYS, "full_outer")
    both = F.col("_in_old").isNotNull() & F.col("_in_new").isNotNull()
    same = (F.col("old_signature").eqNullSafe(F.col("new_signature"))
            & F.col("old_doc").eqNullSafe(F.col("new_doc")))
    j = j.withColumn("_differs", both & ~same)
    j = (j.withColumn("old_params", params_of(F.col("old_signature"), F.col("_differs")))
          .withColumn("new_params", params_of(F.col("new_signature"), F.col("_differs"))))
    code = F.when(F.col("_differs"),
                  compare_code(F.col("old_params"), F.col("new_params"))
                  ).otherwise(F.lit(0))
    change = (F.when(F.col("_in_new").isNull(), "deleted")
              .when(F.col("_in_old").isNull(), "added")
              .when(F.col("code") == 2, "modified_A")
              .when(F.col("code") == 1, "modified_B")
              .otherwise("unchanged"))
    return (j.withColumn("code", code)
            .withColumn("change", change)
            .select(*KEYS, "change", "code", "old_signature", "old_doc",
                    "new_signature", "new_doc"))


def deleted(changes: DataFrame) -> DataFrame:
    """Old entries whose name is gone (the same as a left anti join)."""
    return changes.where("change = 'deleted'").select(
        *KEYS, F.col("old_signature").alias("signature"),
        F.col("old_doc").alias("doc"))


def added(changes: DataFrame) -> DataFrame:
    """New entries whose name is new."""
    return changes.where("change = 'added'").select(
        *KEYS, F.col("new_signature").alias("signature"),
        F.col("new_doc").alias("doc"))


def modified(changes: DataFrame, klass: str) -> DataFrame:
    """D3: modified pairs of class 'A' (required args) or 'B' (optional)."""
    return changes.where(F.col("change") == f"modified_{klass}").select(
        *KEYS, "old_signature", "new_signature", "old_doc", "new_doc")


def change_counts(changes: DataFrame) -> DataFrame:
    """APIs per (lib, kind, change) with the folder label."""
    label = F.create_map(*[F.lit(x) for kv in CATEGORY.items() for x in kv])
    return (changes.groupBy("lib", "kind", "change")
            .agg(F.count(F.lit(1)).alias("n_apis"))
            .withColumn("category",
                        F.coalesce(label[F.col("change")], F.lit("Unchanged_API"))))


def changed_api_lookup(changes: DataFrame) -> DataFrame:
    """Name -> updated and outdated entry of every modified API.

    The name is the signature up to its first bracket, as the reference
    keys it; ``lib`` and ``kind`` stay in the key so that no library can
    overwrite another's entry.
    """
    return (changes.where(F.col("change").isin("modified_A", "modified_B"))
            .select("lib", "kind",
                    F.substring_index("new_signature", "(", 1).alias("api_name"),
                    "change",
                    F.col("new_signature").alias("updated_signature"),
                    F.col("new_doc").alias("updated_doc"),
                    F.substring_index("old_signature", "(", 1).alias("outdated_name"),
                    F.col("old_signature").alias("outdated_signature"),
                    F.col("old_doc").alias("outdated_doc")))


def by_class(changes: DataFrame) -> DataFrame:
    """The entries of each change class, with ``category`` as its folder.

    Added, deleted and modified classes hold the entry that names them; the
    outdated entries of modified APIs are classes of their own (Outdated_API_A
    and _B). ``sources.jsonl.sink_by_class`` writes them.
    """
    label = F.create_map(*[F.lit(x) for kv in CATEGORY.items() for x in kv])
    gone = F.col("change") == "deleted"
    entry = changes.where("change <> 'unchanged'").select(
        "lib", "kind", label[F.col("change")].alias("category"), "api_path",
        F.when(gone, F.col("old_signature")).otherwise(F.col("new_signature")).alias("signature"),
        F.when(gone, F.col("old_doc")).otherwise(F.col("new_doc")).alias("doc"))
    outdated = changes.where("change IN ('modified_A', 'modified_B')").select(
        "lib", "kind", F.replace(label[F.col("change")], F.lit("Modified"), F.lit("Outdated")).alias("category"),
        "api_path", F.col("old_signature").alias("signature"), F.col("old_doc").alias("doc"))
    return entry.unionByName(outdated)
