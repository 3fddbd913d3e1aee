"""Two files of metrics, as ``bench.py`` appends them with BENCH_CSV, as one Markdown table: ``python -m tessera.report OURS THEIRS``."""

from __future__ import annotations

import csv
import sys


def newest(path: str) -> dict[tuple[str, str], float]:
    """Seconds by scale and query; of several runs the one of the latest time counts."""
    with open(path, newline="") as lines:
        rows = sorted(r for r in csv.reader(lines) if r)
    return {(scale, query): float(seconds) for _, scale, query, seconds in rows}


def report(ours: str, theirs: str) -> str:
    """Queries that both files have, with the ratio of the second's time to the first's."""
    a, b = newest(ours), newest(theirs)
    lines = ["| SF | Query | ours s | theirs s | ratio |", "|---|---|---|---|---|"]
    for scale, query in sorted(a.keys() & b.keys()):
        x, y = a[scale, query], b[scale, query]
        lines.append(f"| {scale} | {query} | {x:.4f} | {y:.4f} | {y / x:.2f} |" if x else f"| {scale} | {query} | {x:.4f} | {y:.4f} | - |")
    return "\n".join(lines)


if __name__ == "__main__":
    print(report(*sys.argv[1:3]))
