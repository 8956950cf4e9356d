"""Times the headline queries and prints one line of JSON. BENCH_SF_DIR, BENCH_CPUS and BENCH_NUMBERS set the data, cores and row counts."""

from __future__ import annotations

import json
import os
import statistics
import time

from millrace.plans import catalog
from millrace.plans.session import session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
NUMBERS = int(os.environ.get("BENCH_NUMBERS", 4_000_000_000))
REPEATS = int(os.environ.get("BENCH_REPEATS", 3))

#: Beyond 4.29e9 numbers their sum leaves 64 bits, which is an error.
#: Name, share of NUMBERS, and rows and seconds of the published run on 32 threads.
PUBLISHED = {
    "numbers_filtered_count": (1.0, 1e11, 7.4),
    "numbers_filtered_count_star": (1.0, 1e11, 7.4),
    "numbers_filtered_minmax": (1.0, 1e11, 8.5),
    "numbers_avg_max_sum": (1.0, 1e11, 2.5),
    "numbers_group_mod": (0.25, 1e10, 5.27),
}
TABLES = ("flagship_lineitem", "agg_global", "group_multi_key", "group_many_groups", "and_or_nulls", "regex_match_cs", "union_then_group", "arith_rem_mixed")


def timed(make) -> float:
    """The median of the repeats after one run that compiles code."""
    spans = []
    for _ in range(REPEATS + 1):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        spans.append(time.perf_counter() - began)
    return round(statistics.median(spans[1:]), 4)


def main() -> None:
    spark = session(f"local[{CPUS}]", "bench", shuffle_partitions=int(CPUS), **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, rates = {}, {}
    for name, (share, rows, seconds) in PUBLISHED.items():
        n = int(NUMBERS * share)
        queries[name] = timed(lambda name=name, n=n: catalog.numbers_query(spark, name, n).dataframe())
        rates[name] = {"rows": n, "rows_per_s": round(n / queries[name]), "published_rows_per_s_32_threads": round(rows / seconds)}
    for name in TABLES:
        queries[name] = timed(lambda name=name: catalog.QUERIES[name](spark, SF_DIR))
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": int(CPUS), "numbers": rates}))


if __name__ == "__main__":
    main()
