"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "setup", "sf", ...}.
The stored corpora and their indexes, which every query of a session shares,
are made first and timed apart (``setup``). Each query is run to completion through the no-op sink (every row is
computed, nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import platform
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["api_changes", "function_calls_first", "search_top_m", "method_metadata",
            "marker_log", "usage_test", "bench_cct"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    from pyspark import __version__ as spark_version

    from apidrift.plans import queries
    from apidrift.plans.queries import REGISTRY
    from apidrift.session import get_spark

    spark = get_spark(f"local[{cpus}]", app="apidrift-bench", shuffle_partitions=cpus * 4)
    # warm-up on a generated range (no test data): JVM codegen and the
    # Python worker daemon, so the first query does not pay their start
    def ident(batches):
        yield from batches

    spark.range(1000).selectExpr("sum(id)").collect()
    spark.range(1000).repartition(cpus).mapInArrow(ident, "id long").collect()
    setup = {}
    for name, make in {
            "corpus_functions": lambda: queries._corpus(spark, sf_dir),
            "corpus_methods": lambda: queries._mcorpus(spark, sf_dir),
            "index_functions": lambda: queries._index(spark, sf_dir, "functions", queries._corpus),
            "index_methods": lambda: queries._index(spark, sf_dir, "methods", queries._mcorpus)}.items():
        t0 = time.time()
        make()
        setup[name] = round(time.time() - t0, 3)
    times = {}
    for name in names:
        t0 = time.time()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total_wall", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "setup": setup, "sf": float(m.group(1)) if m else None,
        "cpus": cpus, "spark": spark_version, "python": platform.python_version()}))


if __name__ == "__main__":
    main()
