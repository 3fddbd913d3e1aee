"""Times the registered queries; prints one JSON line and, with BENCH_CSV, appends the metrics to a file."""

from __future__ import annotations

import csv
import json
import os
import statistics
import time

from tessera.plans.registry import REGISTRY
from tessera.session import build_session

HEADLINE = ("selection_lt_1000", "selection_lt_10000", "selection_lt_50000", "aggregation_sum_quantity", "join_semi_count", "join_inner_count", "q1", "q3", "q6", "q9", "q13")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = build_session("tessera-bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        each = []
        for i in range(runs + 1):
            began = time.perf_counter()
            REGISTRY[name][0](spark, sf_dir).collect()
            if i:  # the first run compiles code
                each.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(each), 4)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    if path := os.environ.get("BENCH_CSV"):
        with open(path, "a", newline="") as out:
            csv.writer(out).writerows([time.strftime("%Y%m%d_%H%M%S"), scale, k, v] for k, v in seconds.items())
    spark.stop()
    print(json.dumps({"metric": "sum of median query seconds", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
