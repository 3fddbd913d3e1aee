"""Extension: the pricing summary kept up to date over a folder that receives lineitem files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import exprs as X


def stream_table(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_pricing_summary(lineitem: DataFrame, cutoff: str = "1998-09-02") -> DataFrame:
    """Counts and exact sums by flag and status, for output mode ``complete`` or ``update``."""
    return (
        lineitem.filter(F.col("l_shipdate") <= X.day(cutoff))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.sum(X.disc_price()).alias("sum_disc_price"), F.count("*").alias("count_order"))
    )
