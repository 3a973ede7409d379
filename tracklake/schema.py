"""Names and types of raw points."""

from __future__ import annotations

from pyspark.sql import types as T

# The raw file's columns, in order, and those that are kept.
RAW_COLUMNS = ["company_id", "taxi_id", "license_plate", "timestamp", "longitude", "latitude", "instant_speed", "occupancy_status", "unknown_9", "unknown_10", "unknown_11"]
KEPT_COLUMNS = ["license_plate", "timestamp", "longitude", "latitude", "instant_speed", "occupancy_status"]
NULL_TOKENS = ["N", "n", ""]

TYPES: dict[str, T.DataType] = {
    "license_plate": T.StringType(),
    "timestamp": T.TimestampNTZType(),
    "longitude": T.DoubleType(),
    "latitude": T.DoubleType(),
    "instant_speed": T.DoubleType(),
    "occupancy_status": T.ByteType(),
}

PLATE, TIME = "license_plate", "timestamp"
