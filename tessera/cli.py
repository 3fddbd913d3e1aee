"""Command line: ``python -m tessera.cli [sfDIR] [query]``; the default query is ``all``; SQL text is run as it is."""

from __future__ import annotations

import sys
import time

from tessera.micro import MICRO, line
from tessera.plans.registry import REGISTRY
from tessera.plans.sql import run_sql
from tessera.session import build_session

ALL = {
    "selection": ("selection_lt_1000", "selection_lt_10000", "selection_lt_50000", "selectivity"),
    "aggregation": ("aggregation_sum_quantity",),
    "join": ("join_semi_count", "join_inner_count"),
    "q1": ("q1",),
    "q3": ("q3", "q3_group_count"),
    "q6": ("q6",),
    "q9": ("q9", "q9_yearly"),
    "q13": ("q13",),
}
USAGE = f"usage: python -m tessera.cli [DATASET_DIR] [{'|'.join(ALL)}|all|help|QUERY|'SELECT ...']"


def main(args: list[str]) -> int:
    folder, query = "/root/testdata/sf0.01", "all"
    for arg in args:
        if arg in ("help", "--help", "-h"):
            print(USAGE)
            return 0
        if arg.lower().split(None, 1)[:1] in (["select"], ["with"]):
            run_sql(build_session("tessera-cli"), folder, arg).show(truncate=False)
            return 0
        if "/" in arg:
            folder = arg
        else:
            query = arg.lower()
    names = [n for group in ALL.values() for n in group] if query == "all" else ALL.get(query, (query,))
    if any(n not in REGISTRY for n in names):
        print(f"unknown query: {query}\n{USAGE}", file=sys.stderr)
        return 1
    spark = build_session("tessera-cli")
    for name in names:
        began = time.perf_counter()
        rows = REGISTRY[name][0](spark, folder)
        rows.show(15, truncate=False)
        print(f"{name}: {1000 * (time.perf_counter() - began):.1f} ms")
    for group in MICRO if query == "all" else {query} & MICRO.keys():
        for metrics in MICRO[group](spark, folder):
            print(line(metrics))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
