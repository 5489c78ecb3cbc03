"""The catalog diff against its oracle under shifted fixture constants."""

import duckdb
import pytest

from apidrift.operators import diff
from apidrift.sources import fixtures as X
from tools.check_oracles import digest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("shift", [3, 7])
def test_api_changes_under_shift(spark, shift):
    cat = X.run_sql(spark, SF, X.catalog_sql(X.SPARK, shift))
    old, new = diff.split_catalog(cat, "1.0", "2.0")
    got = [tuple(r) for r in diff.api_changes(old, new).select(
        "lib", "kind", "api_path", "change").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{SF}/part.parquet')")
    want = con.execute(f"""
        SELECT lib, kind, api_path,
          CASE WHEN v = 0 THEN 'deleted' WHEN v = 1 THEN 'added'
               WHEN v IN (3, 9) THEN 'modified_A' WHEN v IN (4, 5) THEN 'modified_B'
               ELSE 'unchanged' END AS change
        FROM ({X.catalog_base_sql(X.DUCK, shift)}) b""").fetchall()
    cols = ["lib", "kind", "api_path", "change"]
    assert digest(cols, got)[0] == digest(cols, want)[0]
    assert len({c for *_, c in got}) == 5
