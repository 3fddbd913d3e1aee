"""Queries as SQL text over a dataset folder: comma joins, explicit joins and derived tables go to Catalyst as written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.tables import table

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def open_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = NAMES) -> None:
    """Names the tables of a dataset for SQL in this session; a view of the same name is replaced."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def run_sql(spark: SparkSession, sf_dir: str, text: str, names: tuple[str, ...] = NAMES) -> DataFrame:
    open_views(spark, sf_dir, names)
    return spark.sql(text)
