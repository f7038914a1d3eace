"""The example census: 40 rows at radii 10 and 20, made from row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def example_census(spark: SparkSession) -> DataFrame:
    """O1.1 rises by row, O1.2 is the rest to 100, S1.1 falls; X and Y lie on a grid."""
    row = F.col("id")
    share = (row % 20) * 100 / 19
    return spark.range(40).select(share.alias("O1.1"), (100 - share).alias("O1.2"), (5 - share / 20).alias("S1.1"), (row % 5 + 1).cast("double").alias("X"), F.floor(row % 20 / 5 + 1).cast("double").alias("Y"), F.lit(1.0).alias("Z"), F.when(row < 20, 10.0).otherwise(20.0).alias("Radius"))
