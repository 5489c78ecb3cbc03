"""Signature parsing (C1-C3) and comparison (C4) as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAM_TYPE = ("array<struct<name:string,kind:string,pos:int,"
              "has_default:boolean,default_src:string>>")

NAMED_KINDS = ("POSITIONAL_ONLY", "POSITIONAL_OR_KEYWORD", "KEYWORD_ONLY")


def _parse_batches(compat: bool):
    def run(batches):
        import pyarrow as pa

        from apidrift.functions.sigparse import parse_signature

        ptype = pa.list_(pa.struct([
            ("name", pa.string()), ("kind", pa.string()), ("pos", pa.int32()),
            ("has_default", pa.bool_()), ("default_src", pa.string())]))
        for b in batches:
            sigs = b.column(0).to_pylist()
            params = [parse_signature(s, compat=compat) for s in sigs]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(params, type=ptype)],
                names=["signature", "params"])
    return run


def _params_array(values, compat=False):
    import pyarrow as pa

    from apidrift.functions.sigparse import parse_signature

    ptype = pa.list_(pa.struct([
        ("name", pa.string()), ("kind", pa.string()), ("pos", pa.int32()),
        ("has_default", pa.bool_()), ("default_src", pa.string())]))
    return pa.array([parse_signature(v, compat=compat) for v in values], type=ptype)


def params_of(sig: Column, when: Column | None = None, compat: bool = False) -> Column:
    """C2 as an Arrow-batched column function: parameters of ``sig``.

    With ``when``, rows where it is false are not parsed (NULL), so a
    column of mostly unchanged pairs costs next to nothing in Python.
    """
    from pyspark.sql.functions import arrow_udf

    @arrow_udf(PARAM_TYPE)
    def parse(s, w):
        flags = w.to_pylist()
        vals = [v if f else None for v, f in zip(s.to_pylist(), flags)]
        return _params_array(vals, compat)

    return parse(sig, when if when is not None else F.lit(True))


def parse_signatures(sigs: DataFrame, col: str = "signature",
                     compat: bool = False) -> DataFrame:
    """Distinct signatures -> (signature, params); params NULL if unparsable.

    Input may hold repeats; they are removed first so each text is parsed
    once (a partial aggregate per task, then one exchange on the text).
    """
    d = sigs.select(F.col(col).alias("signature")).where(
        F.col("signature").isNotNull()).distinct()
    return d.mapInArrow(_parse_batches(compat),
                        f"signature string, params {PARAM_TYPE}")


def with_params(df: DataFrame, sig_col: str, out_col: str,
                parsed: DataFrame) -> DataFrame:
    """Attach parsed params of ``sig_col`` (left join on the text)."""
    p = parsed.select(F.col("signature").alias(f"__sig_{out_col}"),
                      F.col("params").alias(out_col))
    return df.join(p, df[sig_col] == p[f"__sig_{out_col}"], "left").drop(
        f"__sig_{out_col}")


def params_text(params: Column) -> Column:
    """Compact text of a parameter list: ``x:PK,y:PK=,k:KO=``."""
    return F.array_join(F.transform(params, lambda p: F.concat(
        p["name"], F.lit(":"),
        F.when(p["kind"] == "POSITIONAL_ONLY", "PO")
         .when(p["kind"] == "POSITIONAL_OR_KEYWORD", "PK")
         .when(p["kind"] == "VAR_POSITIONAL", "VP")
         .when(p["kind"] == "KEYWORD_ONLY", "KO")
         .otherwise("VK"),
        F.when(p["has_default"], "=").otherwise(""))), ",")


def _of(params: Column, *kinds: str) -> Column:
    return F.filter(params, lambda p: p["kind"].isin(*kinds))


def _names(params: Column) -> Column:
    return F.array_distinct(F.transform(_of(params, *NAMED_KINDS),
                                        lambda p: p["name"]))


def _first_default(params: Column, name: Column) -> Column:
    # has_default of the first parameter carrying this name
    return F.get(F.filter(params, lambda p: p["name"] == name), 0)["has_default"]


def compare_code(old: Column, new: Column) -> Column:
    """0 = same, 1 = optional arguments changed, 2 = required ones changed.

    One CASE over higher-order functions; runs in codegen, no shuffle.
    Tests in order: unparsed side -> 0; a common name whose default-ness
    differs, or a name only on one side without default -> 2; count of
    positional-only or positional-or-keyword differs, or a positional
    name/kind differs at a place, or keyword-only name sets differ, or
    presence of *args / **kwargs differs -> 1; else 0.
    """
    n_old, n_new = _names(old), _names(new)
    required = (
        F.exists(F.array_intersect(n_old, n_new),
                 lambda n: _first_default(old, n) != _first_default(new, n))
        | F.exists(F.array_except(n_old, n_new),
                   lambda n: ~_first_default(old, n))
        | F.exists(F.array_except(n_new, n_old),
                   lambda n: ~_first_default(new, n)))
    pos = ("POSITIONAL_ONLY", "POSITIONAL_OR_KEYWORD")
    kw_old = F.array_sort(F.array_distinct(F.transform(
        _of(old, "KEYWORD_ONLY"), lambda p: p["name"])))
    kw_new = F.array_sort(F.array_distinct(F.transform(
        _of(new, "KEYWORD_ONLY"), lambda p: p["name"])))
    optional = (
        (F.size(_of(old, "POSITIONAL_ONLY")) != F.size(_of(new, "POSITIONAL_ONLY")))
        | (F.size(_of(old, "POSITIONAL_OR_KEYWORD"))
           != F.size(_of(new, "POSITIONAL_OR_KEYWORD")))
        | F.exists(F.zip_with(_of(old, *pos), _of(new, *pos),
                              lambda a, b: (a["name"] != b["name"])
                              | (a["kind"] != b["kind"])), lambda x: x)
        | (kw_old != kw_new)
        | (F.size(_of(old, "VAR_POSITIONAL")) != F.size(_of(new, "VAR_POSITIONAL")))
        | (F.size(_of(old, "VAR_KEYWORD")) != F.size(_of(new, "VAR_KEYWORD"))))
    return (F.when(old.isNull() | new.isNull(), F.lit(0))
            .when(required, F.lit(2))
            .when(optional, F.lit(1))
            .otherwise(F.lit(0)))


def parse_error_counts(catalog: DataFrame) -> DataFrame:
    """Signatures and parse failures per (lib, version); ``catalog``
    carries a ``params`` column (see ``params_of``)."""
    return catalog.groupBy("lib", "version").agg(
        F.count(F.lit(1)).alias("n_signatures"),
        F.count_if(F.col("params").isNull()).alias("n_errors"))
