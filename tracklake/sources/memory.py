"""Points from literal columns, with their times as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def points_from_columns(spark: SparkSession, columns: dict[str, list], timestamp_format: str = "yyyy-MM-dd'T'HH:mm:ss", timestamp: str = "timestamp") -> DataFrame:
    """A table of the columns; the one named ``timestamp`` is read by the format, and null where it can't be."""
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), list(columns))
    if timestamp not in columns:
        return df
    return df.withColumn(timestamp, F.try_to_timestamp(F.col(timestamp), F.lit(timestamp_format)).cast("timestamp_ntz"))
