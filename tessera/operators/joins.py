"""Equi-joins. None carries a broadcast hint: AQE broadcasts a side only after it has measured it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed(rows: DataFrame, **names: str) -> DataFrame:
    """Only the renamed columns ``new=old``, so that scans stay narrow."""
    return rows.select(*[F.col(old).alias(new) for new, old in names.items()])


def semi_count(probe: DataFrame, probe_key: str, build: DataFrame, build_key: str) -> DataFrame:
    """Probe rows that have a partner; duplicates in the build side don't count twice."""
    return keyed(probe, k=probe_key).join(keyed(build, k=build_key), "k", "left_semi").agg(F.count("*").alias("n"))


def inner_count(probe: DataFrame, probe_key: str, build: DataFrame, build_key: str) -> DataFrame:
    """Joined pairs: each build row adds the probe rows of its key, which are counted before the join, so a hot key expands no rows."""
    counted = keyed(probe, k=probe_key).filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("a"))
    return keyed(build, k=build_key).join(counted, "k").agg(F.coalesce(F.sum("a"), F.lit(0)).cast("bigint").alias("n"))


def outer_match_counts(rows: DataFrame, key: str, other: DataFrame, other_key: str, value: str, name: str) -> DataFrame:
    """Matches per key, 0 without any. The other side is counted before it is joined, so no hot key is expanded."""
    counted = other.groupBy(F.col(other_key).alias(key)).agg(F.count(value).alias("_m"))
    base = rows.groupBy(key).agg(F.count("*").alias("_r"))
    return base.join(counted, key, "left").select(key, (F.col("_r") * F.coalesce("_m", F.lit(0))).alias(name))
