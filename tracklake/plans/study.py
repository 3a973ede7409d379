"""Threshold study: percentile tiers, descriptions and histograms of gaps and speeds, as tables and CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tracklake.operators import features, quantiles
from tracklake.operators.staging import stage
from tracklake.sources.parquet import save_csv

MEASURES = {"time_diff": "time_diff_seconds", "speed": "implied_speed_kph"}
#: Bins of the histograms of all values, of those within the threshold, and beyond.
BINS = {"raw": 500, "clean": 200, "outliers": 100}


def segments(points: DataFrame) -> DataFrame:
    made = features.add_implied_speed(features.add_time_distance(points))
    return features.contiguous_occupied(made).select(*MEASURES.values())


def threshold_study(points: DataFrame, output: str | None = None, multiplier: float = 1.5) -> dict[str, DataFrame]:
    """All tables by name; with ``output`` each is also a CSV file there."""
    own = stage(segments(points))
    found = dict(zip(MEASURES, quantiles.point_thresholds(points, multiplier, "contiguous"), strict=True))
    out: dict[str, DataFrame] = {}
    for name, column in MEASURES.items():
        limit = found[name]
        clean = own.filter(own[column] <= limit)
        beyond = own.filter(own[column] > limit)
        out[f"summary_{name}_raw"] = quantiles.describe(own, [column])
        out[f"summary_{name}_clean"] = quantiles.describe(clean, [column])
        tiers = quantiles.percentile_tiers(own, column, limit)
        for tier in quantiles.TIERS:
            out[f"percentiles_{name}_{tier}"] = tiers.filter(tiers.tier == tier).select("percentile", "value")
        for part, rows in (("raw", own), ("clean", clean), ("outliers", beyond)):
            out[f"histogram_{name}_{part}"] = quantiles.histogram(rows, column, BINS[part])
    if output:
        for name, t in out.items():
            save_csv(t, f"{output}/{name}")
    return out
