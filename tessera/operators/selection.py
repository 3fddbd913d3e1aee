"""Range selection and its selectivity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_below(rows: DataFrame, column: str, bound: int) -> DataFrame:
    """Rows with ``column < bound``; a null never passes."""
    return rows.filter(F.col(column) < bound)


def selection_flags(rows: DataFrame, column: str, bound: int) -> DataFrame:
    """All rows with a 0/1 ``flag``, the selection as a bitmap."""
    return rows.withColumn("flag", F.when(F.col(column) < bound, 1).otherwise(0))


def selectivity(rows: DataFrame, column: str, bounds: tuple[int, ...]) -> DataFrame:
    """Matches and percentage for every bound, in one scan and one partial aggregation."""
    counted = rows.agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(column) < b).alias(f"m{i}") for i, b in enumerate(bounds)],
    )
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("v"), F.col(f"m{i}").alias("matched")) for i, b in enumerate(bounds)]))
    return counted.select("n", each.alias("x")).select(
        F.col("x.v").cast("int").alias("v"),
        F.col("x.matched").alias("matched"),
        F.round(F.col("x.matched") * 100.0 / F.col("n"), 6).alias("pct"),
    )
