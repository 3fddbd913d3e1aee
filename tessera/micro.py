"""Metrics of the three micro-benchmarks: time, bytes of the column that is read per second, and build and probe of the join.

Times are medians over runs after a first one, which compiles code. The join's build side is cached, so that probing
doesn't read it again: build is the time to fill the cache, probe the time of the join over it.
"""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import aggregation, joins, selection
from tessera.sources.tables import table

BOUNDS = (1000, 10000, 50000)


def timed(run: Callable[[], Any], runs: int) -> tuple[Any, float]:
    """The result and the median seconds of ``runs`` runs after a warm-up."""
    result, seconds = run(), []
    for _ in range(runs):
        began = time.perf_counter()
        result = run()
        seconds.append(time.perf_counter() - began)
    return result, statistics.median(seconds)


def _width(rows: DataFrame, column: str) -> int:
    return {"int": 4, "date": 4, "float": 4}.get(rows.schema[column].dataType.simpleString(), 8)


def selection_metrics(spark: SparkSession, folder: str, runs: int = 3) -> list[dict]:
    """For each bound: matches, selectivity in per cent, milliseconds and GB/s of the key column."""
    lines = table(spark, folder, "lineitem")
    n, out = lines.count(), []
    for bound in BOUNDS:
        counted = selection.select_below(lines, "l_partkey", bound).agg(F.count("*").alias("n"))
        matched, seconds = timed(lambda rows=counted: rows.first().n, runs)
        share = 100 * matched / n if n else 0.0
        out.append({"query": f"selection_lt_{bound}", "matches": matched, "selectivity_pct": share, "ms": 1e3 * seconds, "gb_s": n * _width(lines, "l_partkey") / seconds / 1e9})
    return out


def aggregation_metrics(spark: SparkSession, folder: str, runs: int = 3) -> list[dict]:
    """The sum of the quantities, milliseconds and GB/s of the column."""
    lines = table(spark, folder, "lineitem")
    n = lines.count()
    total, seconds = timed(lambda: aggregation.total(lines, "l_quantity", "s").first().s, runs)
    return [{"query": "aggregation_sum_quantity", "sum": total, "ms": 1e3 * seconds, "gb_s": n * _width(lines, "l_quantity") / seconds / 1e9}]


def join_metrics(spark: SparkSession, folder: str, runs: int = 3) -> list[dict]:
    """Matches of the semi-join and milliseconds to build, to probe and in all."""
    keys, lines = joins.keyed(table(spark, folder, "orders"), o_orderkey="o_orderkey"), table(spark, folder, "lineitem")
    cached: list[DataFrame] = []

    def build() -> int:
        while cached:
            cached.pop().unpersist(blocking=True)
        cached.append(keys.select("o_orderkey").cache())
        return cached[0].count()

    _, built = timed(build, runs)
    matches, probed = timed(lambda: joins.semi_count(lines, "l_orderkey", cached[0], "o_orderkey").first().n, runs)
    cached.pop().unpersist()
    return [{"query": "join_semi_count", "matches": matches, "build_ms": 1e3 * built, "probe_ms": 1e3 * probed, "ms": 1e3 * (built + probed)}]


MICRO = {"selection": selection_metrics, "aggregation": aggregation_metrics, "join": join_metrics}


def line(metrics: dict) -> str:
    return "  ".join(f"{k}={v:.3f}" if isinstance(v, float) else f"{k}={v}" for k, v in metrics.items())
