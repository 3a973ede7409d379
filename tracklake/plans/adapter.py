"""Points made of the events table, for data without positions: fixed arithmetic places each event, its user is the vehicle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def points_of_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("京A"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("license_plate"),
        F.col("ts").alias("timestamp"),
        F.col("event_id").alias("key"),
        F.col("value").alias("instant_speed"),
        (F.lit(115.5) + (F.col("event_id") * 7) % 200 / F.lit(100.0)).alias("longitude"),
        (F.lit(39.2) + (F.col("event_id") * 13) % 260 / F.lit(100.0)).alias("latitude"),
        F.when(F.col("event_type").isin("click", "view", "purchase"), 1).otherwise(0).cast("tinyint").alias("occupancy_status"),
    )


def read_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points_of_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
