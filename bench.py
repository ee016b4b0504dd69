"""Times the headline queries: one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_ROUNDS set the tables, cores and repeats."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from skarn.api import Engine
from skarn.plans import QUERIES
from skarn.session import local_session

HEADLINE = [
    "a0_flagship", "p6_where", "p16_exists", "p18_all", "p19_scalar_subquery", "j9_multiway", "j11_semi_anti", "a9_grouping_sets", "a10_rollup", "a11_cube", "a16_distinct",
    "w1_row_number", "w8_sum", "w10_min", "w12_lag", "o6_top_k", "u9_ordered", "c1_with", "s6_unnest", "s10_lateral", "d6_timestampadd", "x1_json_value_column",
]


def main() -> None:
    sf_dir, cpus, rounds = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8")), int(os.environ.get("BENCH_ROUNDS", "3"))
    spark = local_session(cpus, cpus)
    spark.sparkContext.setLogLevel("ERROR")
    Engine(spark, sf_dir).sql("SELECT COUNT(*) AS n FROM lineitem").collect()
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(rounds + 1):  # the first one warms up
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 4)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
