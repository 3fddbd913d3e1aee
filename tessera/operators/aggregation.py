"""Global aggregates, key maxima and the histogram of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(rows: DataFrame, value: Column | str, name: str) -> DataFrame:
    """One row with the sum; null over no rows."""
    return rows.agg(F.sum(value).alias(name))


def histogram_of_counts(rows: DataFrame, count: str, name: str) -> DataFrame:
    """How many rows have each value of ``count``."""
    return rows.groupBy(count).agg(F.count("*").alias(name))


def max_keys(keys: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """One row with the maximum of a key column per named table; each side of the joins has one row."""
    out: DataFrame | None = None
    for name, (rows, column) in keys.items():
        top = rows.agg(F.max(column).alias(name)).withColumn("_one", F.lit(1))
        out = top if out is None else out.join(top, "_one")
    return out.drop("_one")
