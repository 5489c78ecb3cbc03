"""Row conversion (V1, V2) and the change filter (G1)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apidrift.operators.diff import CATEGORY



def switch(df: DataFrame, convert: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """V1: apply a user conversion to every row (a DataFrame -> DataFrame
    function, so it stays inside Catalyst; use ``mapInPandas`` inside it
    only when no expression can say it)."""
    return df.transform(convert)


def repair_import(text: str | None) -> str | None:
    """An import block whose first syntax error is a trailing comma gets
    ``wrong_package`` appended to that line (as the reference does)."""
    import ast
    import warnings

    if text is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except SyntaxError as e:
        if e.msg and "trailing comma" in e.msg and e.lineno:
            lines = text.split("\n")
            i = e.lineno - 1
            return ("\n".join(lines[:i]) + "\n" + lines[i] + "wrong_package" + "\n"
                    + "\n".join(lines[i + 1:]))
    except (ValueError, RecursionError, MemoryError):
        pass
    return text


def build_content(df: DataFrame) -> DataFrame:
    """V2: legacy (import, code) rows -> content = import + 4 newlines +
    dedented code (Arrow-batched Python: dedent and the syntax check have
    no Catalyst equivalent)."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def content(imp, code):
        import textwrap

        import pyarrow as pa

        out = []
        for i, c in zip(imp.to_pylist(), code.to_pylist()):
            if i is None or c is None:
                out.append(None)
            else:
                out.append(repair_import(i) + "\n" * 4 + textwrap.dedent(c))
        return pa.array(out, pa.string())

    return df.withColumn("content", content(F.col("import"), F.col("code")))


def filter_changed(sites: DataFrame, changes: DataFrame) -> DataFrame:
    """G1: keep call sites whose API changed in class A or B; label them.

    ``sites`` needs lib, kind and API_path.
    """
    ch = changes.where(F.col("change").isin("modified_A", "modified_B")).select(
        "lib", "kind", F.col("api_path").alias("API_path"), "change")
    label = F.create_map(*[F.lit(x) for kv in CATEGORY.items() for x in kv])
    ch = ch.withColumn("category", label[F.col("change")])
    return sites.join(ch, ["lib", "kind", "API_path"])
