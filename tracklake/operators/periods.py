"""Occupancy periods: runs of a vehicle's points with one status, their summary, and the join of points to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.geodesy import haversine_km
from tracklake.operators.features import TIE, track
from tracklake.operators.quantiles import iqr_threshold
from tracklake.operators.staging import stage
from tracklake.schema import PLATE, TIME

#: Width of the time bins by which points meet periods. A period is entered in every bin it touches.
BIN_SECONDS = 86_400


def add_period_id(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """period_id from 1 over all vehicles in the order of their plates.

    A period begins where a vehicle's status changes or either status is null, and at its first point. Ids are counted within each vehicle and
    shifted by the number of periods before it, so the points are never gathered into one task; only one row for each
    vehicle is. Rows without a plate come first, each a period of its own.
    """
    w = track(df, order)
    status = F.col("occupancy_status")
    change = F.col(PLATE).isNull() | F.coalesce(status != F.lag(status).over(w), F.lit(True))
    df = df.withColumn("change_", change.cast("int"))
    df = df.withColumn("local_", F.sum("change_").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sizes = df.groupBy(PLATE).agg(F.max("local_").alias("n_")).select(F.col(PLATE).alias("plate_"), (F.sum("n_").over(Window.orderBy(F.asc_nulls_first(PLATE)).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_")).alias("before_"))
    out = df.join(sizes, F.col(PLATE).eqNullSafe(F.col("plate_")))
    return out.withColumn("period_id", (F.col("local_") + F.col("before_")).cast("int")).drop("change_", "local_", "plate_", "before_")


def add_period_id_in_order(df: DataFrame, row_key: str) -> DataFrame:
    """period_id for points in a caller's own order, in which a plate that comes back starts a new period.

    The rows are dealt by ranges of the key; ids are counted within each range and shifted by the periods before it, and a range's
    first row is held against the last row of the range before. One row for each range meets in one task. Keys should be
    unique: rows of one key have no order among them. A null plate or status starts a period, as the row after it does.
    """
    ranged = stage(df.repartitionByRange(row_key).withColumn("range_", F.spark_partition_id()))
    ranges, own = Window.orderBy("range_"), Window.partitionBy("range_").orderBy(row_key)
    point = F.struct(F.col(PLATE).alias("p"), F.col("occupancy_status").alias("s"))
    ends = ranged.groupBy("range_").agg(F.max_by(point, F.struct(row_key)).alias("end_"))
    before = ends.select("range_", F.lag("end_").over(ranges).alias("end_"))
    last = F.coalesce(F.lag(point).over(own), F.col("end_"))
    change = F.coalesce((F.col(PLATE) != last.p) | (F.col("occupancy_status") != last.s), F.lit(True))
    marked = ranged.join(before, "range_").withColumn("local_", F.sum(change.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    marked = stage(marked.drop("end_"))
    sizes = marked.groupBy("range_").agg(F.max("local_").alias("n_"))
    sizes = sizes.select("range_", (F.sum("n_").over(ranges.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_")).alias("before_"))
    return marked.join(sizes, "range_").withColumn("period_id", (F.col("local_") + F.col("before_")).cast("int")).drop("range_", "local_", "before_")


def summarize_periods(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row for each period: bounds, count, mean speed, sums of time and distance, duration; with coordinates also the
    straight-line distance between its ends, and how much longer the way was (0 where the ends coincide)."""
    names = order or [TIME, *([TIE] if TIE in df.columns else [])]
    at = F.struct(*names)
    placed = {"latitude", "longitude"} <= set(df.columns)
    ends = [f(c, at).alias(f"{n}_{c}_") for c in ("latitude", "longitude") for n, f in (("first", F.min_by), ("last", F.max_by))] if placed else []
    out = df.groupBy(PLATE, "occupancy_status", "period_id").agg(
        F.min(TIME).alias("start_time"),
        F.max(TIME).alias("end_time"),
        F.count(F.lit(1)).alias("count_rows"),
        F.avg("implied_speed_kph").alias("avg_implied_speed"),
        F.coalesce(F.sum("time_diff_seconds"), F.lit(0)).alias("sum_time_diff"),
        F.coalesce(F.sum("distance_km"), F.lit(0.0)).alias("sum_distance"),
        *ends,
    )
    out = out.withColumn("duration", F.col("end_time") - F.col("start_time"))
    if not placed:
        return out
    km = haversine_km(*[F.col(f"{n}_{c}_") for n in ("first", "last") for c in ("latitude", "longitude")])
    out = out.withColumn("straight_line_distance_km", km).drop(*[f"{n}_{c}_" for n in ("first", "last") for c in ("latitude", "longitude")])
    ratio = F.when(F.col("straight_line_distance_km") > 0, F.col("sum_distance") / F.col("straight_line_distance_km")).otherwise(F.lit(0.0))
    return out.withColumn("sld_ratio", ratio)


def longer_periods(periods: DataFrame, least: int = 3) -> DataFrame:
    return periods.filter(F.col("count_rows") >= least)


def attach_period_id(points: DataFrame, periods: DataFrame, bin_seconds: int = BIN_SECONDS) -> DataFrame:
    """Points with period_id, start_time and end_time of each period of their vehicle that holds their time, both ends included.

    A point on a bound that two periods share is in both; points in no period go. Points and periods meet by vehicle and
    time bin, so a vehicle with many of both isn't compared all against all.
    """
    names = [c for c in points.columns if c not in ("period_id", "start_time", "end_time")]
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    bin_of = lambda t: F.floor(F.timestamp_diff("MICROSECOND", epoch, t) / F.lit(bin_seconds * 1_000_000))
    spans = periods.select(F.col(PLATE).alias("plate_"), "period_id", "start_time", "end_time").withColumn("bin_", F.explode(F.sequence(bin_of(F.col("start_time")), bin_of(F.col("end_time")))))
    binned = points.select(*names, bin_of(F.col(TIME)).alias("at_"))
    match = (F.col(PLATE) == F.col("plate_")) & (F.col("at_") == F.col("bin_")) & F.col(TIME).between(F.col("start_time"), F.col("end_time"))
    return binned.join(spans, match).select(*names, "period_id", "start_time", "end_time")


def add_outlier_counts(periods: DataFrame, points: DataFrame) -> DataFrame:
    """traj_outlier_count, its ratio to the period's points, and is_traj_outlier, from the points' is_outlier (-1: outlier)."""
    stats = points.groupBy(PLATE, "period_id").agg(F.count_if(F.col("is_outlier") == -1).alias("traj_outlier_count"))
    out = periods.join(stats, [PLATE, "period_id"], "left").withColumn("traj_outlier_count", F.coalesce("traj_outlier_count", F.lit(0)))
    ratio = F.coalesce(F.try_divide(F.col("traj_outlier_count"), F.col("count_rows")), F.lit(0.0))
    return out.withColumns({"traj_outlier_ratio": ratio, "is_traj_outlier": F.col("traj_outlier_count") > 0})


def add_detour_flag(periods: DataFrame, multiplier: float = 1.5) -> DataFrame:
    """is_sld_outlier: sld_ratio beyond the quartile threshold of all periods; null where there is no threshold."""
    limit = iqr_threshold(periods, "sld_ratio", multiplier)
    return periods.withColumn("is_sld_outlier", F.col("sld_ratio") > F.lit(limit).cast("double"))
