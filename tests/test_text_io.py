"""Text lines in and out, and the user conversion."""

from pyspark.sql import functions as F

from apidrift.operators import convert
from apidrift.sources import jsonl


def test_lines_round_trip_stripped(spark, tmp_path):
    lines = ["\tone　", "  two words\r", "", "three"]
    jsonl.write_lines(spark.createDataFrame([(x,) for x in lines], "t string"), "t", f"{tmp_path}/lines")
    got = sorted(r["line"] for r in jsonl.read_lines(spark, f"{tmp_path}/lines").collect())
    assert got == sorted(x.strip() for x in lines)


def test_tolerant_read_takes_nested_schemas_and_blank_lines(spark, tmp_path):
    text = ['{"a": {"x": 1}, "b": [1, 2]}', "\t ", "{broken"]
    jsonl.write_lines(spark.createDataFrame([(x,) for x in text], "t string"), "t", f"{tmp_path}/j")
    ok, bad = jsonl.read_tolerant(spark, f"{tmp_path}/j", "a map<string, int>, b array<int>")
    assert [(r["a"], r["b"]) for r in ok.collect()] == [({"x": 1}, [1, 2])] and bad.count() == 1


def test_user_conversion(spark):
    rows = convert.switch(spark.range(3), lambda d: d.select((F.col("id") * 2).alias("double")))
    assert [r[0] for r in rows.collect()] == [0, 2, 4]
