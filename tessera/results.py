"""Result logs: a file for each query, and the comparison of two folders of them.

``python -m tessera.results write DATASET FOLDER [QUERY...]`` runs queries and writes FOLDER/QUERY.csv, a header and the rows in the
query's order; ``python -m tessera.results compare FOLDER GOLDEN`` tells where FOLDER differs from GOLDEN. Rows come to the driver,
so it is for queries whose results are reports; those without an order are sorted by all columns.
"""

from __future__ import annotations

import csv
import math
import os
import sys

from pyspark.sql import DataFrame, SparkSession

#: Queries whose results are short reports.
REPORTS = (
    "selection_lt_1000", "selection_lt_10000", "selection_lt_50000", "selectivity", "aggregation_sum_quantity", "join_semi_count", "join_inner_count",
    "q1", "q1_cent_rounded", "q3", "q3_group_count", "q6", "q9", "q9_yearly", "q13", "part_name_contains_count", "max_keys",
)
ORDERED = ("q1", "q1_cent_rounded", "q3", "q9", "q9_yearly", "q13")


def _text(value: object) -> str:
    return "" if value is None else repr(value) if isinstance(value, float) else str(value)


def write_log(rows: DataFrame, path: str, ordered: bool) -> None:
    lines = [[_text(x) for x in r] for r in rows.collect()]
    with open(path, "w", newline="") as out:
        csv.writer(out).writerows([rows.columns, *(lines if ordered else sorted(lines))])


def write_logs(spark: SparkSession, dataset: str, folder: str, names: tuple[str, ...] = REPORTS) -> None:
    from tessera.plans.registry import REGISTRY

    os.makedirs(folder, exist_ok=True)
    for name in names:
        write_log(REGISTRY[name][0](spark, dataset), f"{folder}/{name}.csv", name in ORDERED)


def _read(path: str) -> list[list[str]]:
    with open(path, newline="") as lines:
        return list(csv.reader(lines))


def _same(a: str, b: str) -> bool:
    if a == b:
        return True
    try:
        return math.isclose(float(a), float(b), rel_tol=1e-9)
    except ValueError:
        return False


def compare(folder: str, golden: str) -> list[str]:
    """What differs, a line for each query: missing files, columns, numbers of rows, and the first row that isn't the same."""
    out = []
    for file in sorted(os.listdir(golden)):
        if not file.endswith(".csv"):
            continue
        name = file.removesuffix(".csv")
        if not os.path.exists(f"{folder}/{file}"):
            out.append(f"{name}: no result")
            continue
        ours, theirs = _read(f"{folder}/{file}"), _read(f"{golden}/{file}")
        if ours[:1] != theirs[:1]:
            out.append(f"{name}: columns {ours[:1]}, not {theirs[:1]}")
        elif len(ours) != len(theirs):
            out.append(f"{name}: {len(ours) - 1} rows, not {len(theirs) - 1}")
        else:
            wrong = next((i for i, (a, b) in enumerate(zip(ours, theirs, strict=True)) if len(a) != len(b) or not all(map(_same, a, b))), None)
            if wrong is not None:
                out.append(f"{name}: row {wrong} is {ours[wrong]}, not {theirs[wrong]}")
    return out


def main(args: list[str]) -> int:
    if args[:1] == ["write"] and len(args) >= 3:
        from tessera.session import build_session

        write_logs(build_session("tessera-results"), args[1], args[2], tuple(args[3:]) or REPORTS)
        return 0
    if args[:1] == ["compare"] and len(args) == 3:
        found = compare(*args[1:])
        print("\n".join(found) or "all equal")
        return int(bool(found))
    print(__doc__, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
