"""Bounded queries for exploring the results: each is a filter that reaches the scan, or a small aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.plates import anonymized, masked
from tracklake.schema import PLATE, TIME


def period_ids(periods: DataFrame, plate: str) -> DataFrame:
    return periods.filter(F.col(PLATE) == plate).select("period_id").distinct().orderBy("period_id")


def period_info(periods: DataFrame, plate: str, period_id: int) -> DataFrame:
    return periods.filter((F.col(PLATE) == plate) & (F.col("period_id") == period_id))


def trajectory(points: DataFrame, plate: str, period_id: int) -> DataFrame:
    """A period's points in time; a point without a label counts as no outlier."""
    own = points.filter((F.col(PLATE) == plate) & (F.col("period_id") == period_id))
    return own.select(TIME, "latitude", "longitude", F.coalesce("is_outlier", F.lit(1)).alias("is_outlier")).orderBy(TIME)


def centroid(points: DataFrame) -> DataFrame:
    return points.agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))


def sample_plates(df: DataFrame, limit: int = 100) -> DataFrame:
    return df.select(PLATE).distinct().orderBy(PLATE).limit(limit)


def occupancy_options(periods: DataFrame) -> DataFrame:
    return periods.select("occupancy_status").distinct().orderBy("occupancy_status")


def filtered_periods(periods: DataFrame, sld: str = "All", model: str = "All", occupancy: Sequence | None = None, hide_small: bool = False) -> DataFrame:
    """Periods by their two flags ("All", "Only outliers", or anything else for those without), statuses, and at least 1 km."""
    for choice, flag in ((sld, "is_sld_outlier"), (model, "is_traj_outlier")):
        if choice != "All":
            periods = periods.filter(F.col(flag) == F.lit(choice == "Only outliers"))
    if occupancy is not None:
        periods = periods.filter(F.col("occupancy_status").isin(list(occupancy)))
    return periods.filter(F.col("sum_distance") >= 1.0) if hide_small else periods


def plate_counts(periods: DataFrame, only_several: bool = False, order: str = "plate") -> DataFrame:
    """(license_plate, n_periods) by plate, or by number ("ascending", "descending") and then plate."""
    counts = periods.groupBy(PLATE).agg(F.count("period_id").alias("n_periods"))
    if only_several:
        counts = counts.filter("n_periods > 1")
    by = {"plate": [PLATE], "ascending": ["n_periods", PLATE], "descending": [F.desc("n_periods"), PLATE]}[order]
    return counts.orderBy(*by)


def navigation(periods: DataFrame) -> DataFrame:
    """Each period of each vehicle with the one before and the one after; the first and the last have themselves."""
    own = periods.select(PLATE, "period_id").distinct()
    w = Window.partitionBy(PLATE).orderBy("period_id")
    return own.select(PLATE, "period_id", F.coalesce(F.lag("period_id").over(w), F.col("period_id")).alias("prev_period"), F.coalesce(F.lead("period_id").over(w), F.col("period_id")).alias("next_period"))


def private(periods: DataFrame, times: Sequence[str] = ("start_time", "end_time")) -> DataFrame:
    """The rows with hashed plates and hidden times."""
    return periods.withColumns({PLATE: anonymized(F.col(PLATE)), **{t: masked(F.col(t)) for t in times}})
