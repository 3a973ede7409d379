"""The main flow: thresholds, features, flags, outlier model, removal of anomalous vehicles, periods, enrichment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.operators import features, periods, quantiles
from tracklake.operators.outliers import detect_outliers
from tracklake.operators.staging import stage
from tracklake.schema import PLATE
from tracklake.sources.parquet import save_parquet


@dataclass
class Cleaned:
    points: DataFrame
    with_period: DataFrame
    periods: DataFrame


def flagged_points(points: DataFrame, multiplier: float = 1.5, mode: str = "occupied", also: list[str] | None = None) -> DataFrame:
    """The point table with both flags, by thresholds from its own occupied points."""
    gap, jump = quantiles.point_thresholds(points, multiplier, mode)
    made = points.transform(features.add_time_distance).transform(features.add_implied_speed)
    limit = lambda v: F.lit(v).cast("double")
    return made.transform(features.add_flags, limit(gap), limit(jump)).transform(features.final_columns, also)


def flagged_plates(flagged: DataFrame) -> DataFrame:
    return features.anomalous(flagged).select("license_plate").distinct()


def clean(flagged: DataFrame) -> DataFrame:
    """The points of vehicles without any flagged point, without the flags; points without a plate go.

    A vehicle's flags are gathered over the window by plate that its features need anyway, so its points aren't shuffled again.
    """
    flag = F.coalesce("is_temporal_gap", F.lit(False)) | F.coalesce("is_position_jump", F.lit(False))
    marked = flagged.withColumn("flagged_", F.bool_or(flag).over(Window.partitionBy(PLATE)))
    return marked.filter(F.col(PLATE).isNotNull() & ~F.col("flagged_")).drop("flagged_", "is_temporal_gap", "is_position_jump")


def period_table(cleaned: DataFrame, least: int = 3) -> DataFrame:
    """The periods of so many points or more. The points are staged, as their ids are counted in one reading and given in another."""
    return periods.longer_periods(periods.summarize_periods(periods.add_period_id(stage(cleaned))), least)


def enrich(period_rows: DataFrame, with_period: DataFrame) -> DataFrame:
    """The periods with their outlier counts and the detour flag."""
    return periods.add_detour_flag(periods.add_outlier_counts(period_rows, with_period))


def run(points: DataFrame, multiplier: float = 1.5, mode: str = "occupied", contamination: float = 0.05, seed: int = 42, least: int = 3, output: str | None = None) -> Cleaned:
    """The whole flow; with ``output`` its three tables are written there as Parquet.

    The outlier model looks at all points before anomalous vehicles are removed, as later steps only read its label.
    """
    tie = [c for c in (features.TIE,) if c in points.columns]
    labelled = stage(detect_outliers(flagged_points(points, multiplier, mode, also=tie), contamination, seed))
    cleaned = stage(clean(labelled))
    rows = stage(periods.longer_periods(periods.summarize_periods(periods.add_period_id(cleaned)), least))
    attached = stage(periods.attach_period_id(cleaned, rows))
    out = Cleaned(cleaned, attached, enrich(rows, attached))
    if output:
        save_parquet(out.points, f"{output}/cleaned_points", "cleaned points")
        save_parquet(out.with_period, f"{output}/cleaned_with_period_id", "cleaned points with their periods")
        save_parquet(out.periods, f"{output}/periods", "periods")
    return out
