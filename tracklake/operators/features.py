"""Per-vehicle features from each point and the one before: time, distance, speed, flags.

All lags share one window, so a vehicle's points are shuffled and sorted once; what groups by the plate afterwards
reuses that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tracklake.functions.geodesy import haversine_km, heading_degrees, speed_kph
from tracklake.schema import PLATE, TIME

#: What follows the time in the order of a vehicle's points, if the table has it; it breaks ties.
TIE = "key"

FINAL_COLUMNS = ["license_plate", "timestamp", "longitude", "latitude", "occupancy_status", "time_diff_duration", "time_diff_seconds", "distance_km", "instant_speed", "implied_speed_kph", "is_temporal_gap", "is_position_jump"]


def track(df: DataFrame, order: list[str] | None = None) -> WindowSpec:
    """A vehicle's points in order: by ``order``, or by time and the tie-break column if there is one."""
    names = order or [TIME, *([TIE] if TIE in df.columns else [])]
    return Window.partitionBy(PLATE).orderBy(*names)


def add_time_distance(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """time_diff_duration, time_diff_seconds (whole, cut towards zero), prev_latitude, prev_longitude, distance_km.

    A vehicle's first point has no time difference, and distance 0; unknown coordinates give distance 0.
    """
    w = track(df, order)
    df = df.withColumns({"prev_timestamp": F.lag(TIME).over(w), "prev_latitude": F.lag("latitude").over(w), "prev_longitude": F.lag("longitude").over(w)})
    km = haversine_km(F.col("prev_latitude"), F.col("prev_longitude"), F.col("latitude"), F.col("longitude"))
    return df.withColumns(
        {
            "time_diff_duration": F.col(TIME) - F.col("prev_timestamp"),
            "time_diff_seconds": F.timestamp_diff("SECOND", F.col("prev_timestamp"), F.col(TIME)),
            "distance_km": F.coalesce(km, F.lit(0.0)),
        }
    ).drop("prev_timestamp")


def add_implied_speed(df: DataFrame) -> DataFrame:
    return df.withColumn("implied_speed_kph", speed_kph(F.col("distance_km"), F.col("time_diff_seconds")))


def add_flags(df: DataFrame, gap_seconds: float | Column, jump_kph: float | Column) -> DataFrame:
    """is_temporal_gap (null where there is no time difference) and is_position_jump; both are strict."""
    limit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.withColumns({"is_temporal_gap": F.col("time_diff_seconds") > limit(gap_seconds), "is_position_jump": F.col("implied_speed_kph") > limit(jump_kph)})


def final_columns(df: DataFrame, also: list[str] | None = None) -> DataFrame:
    """The point table's columns; seconds to 2 decimals, distance to 3, speed to 2. ``also``: further columns to keep."""
    rounded = {"time_diff_seconds": 2, "distance_km": 3, "implied_speed_kph": 2}
    return df.select(*[F.round(c, rounded[c]).alias(c) if c in rounded else F.col(c) for c in FINAL_COLUMNS], *(also or []))


def anomalous(df: DataFrame) -> DataFrame:
    """Rows with either flag set."""
    return df.filter(F.col("is_temporal_gap") | F.col("is_position_jump"))


def contiguous_occupied(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Points that are occupied and whose vehicle's point before was too. Features are to be computed before."""
    status = F.col("occupancy_status").cast("string")
    return df.withColumn("prev_status_", F.lag(status).over(track(df, order))).filter((status == "1") & (F.col("prev_status_") == "1")).drop("prev_status_")


def motion(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """speed, acceleration and direction_change for outlier detection; null where a difference is undefined.

    Differences stay within a vehicle: its first point has none, its second no change of direction.
    """
    w = track(df, order)
    seconds = F.timestamp_diff("SECOND", F.lag(TIME).over(w), F.col(TIME))
    hours = F.nullif(F.col("seconds_") / 3600.0, F.lit(0.0))
    given = {"implied_speed_kph", "time_diff_seconds"} <= set(df.columns)
    df = df.withColumns({"seconds_": F.col("time_diff_seconds") if given else seconds, "lat_": F.lag("latitude").over(w), "lon_": F.lag("longitude").over(w)})
    km = haversine_km(F.col("lat_"), F.col("lon_"), F.col("latitude"), F.col("longitude"))
    first = F.col("lat_").isNull() & F.col("lon_").isNull() & F.col("seconds_").isNull()
    df = df.withColumns({"speed": F.when(~first, F.col("implied_speed_kph") if given else F.try_divide(km, hours)), "heading_": heading_degrees(F.col("latitude") - F.col("lat_"), F.col("longitude") - F.col("lon_"))})
    df = df.withColumns({"acceleration": F.try_divide(F.col("speed") - F.lag("speed").over(w), hours), "direction_change": F.abs(F.col("heading_") - F.lag("heading_").over(w))})
    return df.drop("seconds_", "lat_", "lon_", "heading_")
