"""Features of each vehicle's latest point over a stream, and counts of anomalies by time window.

A vehicle's state is its last point. Rows of one trigger are ordered within it; a row older than the vehicle's last point
came late and is dropped, as its neighbours have been emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracklake.functions.geodesy import EARTH_RADIUS_KM
from tracklake.operators.features import add_flags
from tracklake.schema import PLATE, TIME

FEATURES = "license_plate string, timestamp timestamp, longitude double, latitude double, time_diff_seconds long, distance_km double, implied_speed_kph double"
STATE = "at timestamp, longitude double, latitude double"


def haversine(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    lat1, lon1, lat2, lon2 = map(np.radians, (lat1, lon1, lat2, lon2))
    a = np.clip(np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2, 0, 1)
    return 2 * EARTH_RADIUS_KM * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def next_features(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(parts)).sort_values(TIME, kind="stable", ignore_index=True)
    before = state.getOption
    if before is not None:
        rows = rows[rows[TIME] >= before[0]]
        rows = pd.concat([pd.DataFrame([{TIME: before[0], "longitude": before[1], "latitude": before[2]}]), rows], ignore_index=True)
    if rows.empty:
        return
    last = rows.iloc[-1]
    state.update((last[TIME].to_pydatetime(), float(last["longitude"]), float(last["latitude"])))
    was = rows.shift(1)
    seconds = (rows[TIME] - was[TIME]) // pd.Timedelta(seconds=1)
    km = pd.Series(haversine(was["latitude"].to_numpy(float), was["longitude"].to_numpy(float), rows["latitude"].to_numpy(float), rows["longitude"].to_numpy(float))).fillna(0.0)
    speed = np.where(seconds.fillna(0) > 0, km / (seconds.astype(float) / 3600.0).replace(0, np.nan), 0.0)
    out = pd.DataFrame({PLATE: key[0], TIME: rows[TIME], "longitude": rows["longitude"], "latitude": rows["latitude"], "time_diff_seconds": seconds.astype("Int64"), "distance_km": km, "implied_speed_kph": speed})
    yield out.iloc[1:] if before is not None else out


def stream_features(points: DataFrame) -> DataFrame:
    """Time difference, distance and speed of each point of a stream; needs license_plate, timestamp, longitude, latitude."""
    own = points.select(PLATE, F.col(TIME).cast("timestamp"), "longitude", "latitude").filter(F.col(PLATE).isNotNull() & F.col(TIME).isNotNull())
    return own.groupBy(PLATE).applyInPandasWithState(next_features, FEATURES, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_flags(points: DataFrame, gap_seconds: float, jump_kph: float) -> DataFrame:
    return add_flags(stream_features(points), gap_seconds, jump_kph)


def counts_by_window(points: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Points and distinct-status counts of each window of event time; points later than ``late`` are left out."""
    timed = points.withColumn("at", F.col(TIME).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("occupancy_status") == 1).alias("n_occupied")).select(F.col("window.start").alias("start"), "n", "n_occupied")
