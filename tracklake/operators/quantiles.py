"""Exact quantiles without a global sort, thresholds from quartiles, tiers, descriptions and histograms.

An order statistic is found by counting: equal-width bins over the values' range, then over the one bin that holds the
wanted rank, until few enough values are left to pick from. Only bin counts reach the driver, at any size of the table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tracklake.operators.features import add_implied_speed, add_time_distance, contiguous_occupied
from tracklake.operators.filters import occupied

#: So many values or fewer are sorted in one task.
FEW = 50_000
BINS = 2048


def ranks_of(n: int, q: float, interpolation: str) -> tuple[list[int], float]:
    """The ranks (from 0) that a quantile of n values needs, and the weight of the second."""
    at = (n - 1) * q
    if interpolation == "nearest":
        return [math.floor(at + 0.5)], 0.0
    if interpolation == "linear":
        low = math.floor(at)
        return [low, min(low + 1, n - 1)], at - low
    raise ValueError(f"interpolation must be nearest or linear, not {interpolation!r}")


def order_statistics(values: DataFrame, column: str, n: int, low: float, high: float, ranks: Sequence[int], few: int = FEW) -> dict[int, float]:
    """The values of these ranks among the n non-null ones, which lie between low and high."""
    out: dict[int, float] = {}
    # Intervals of values: (rank of the first in it, how many, least, greatest, wanted ranks).
    todo, small = [(0, n, low, high, sorted(set(ranks)))], []
    while todo:
        base, size, lo, hi, wanted = todo.pop()
        if not lo < hi:
            out |= dict.fromkeys(wanted, lo)
            continue
        if size <= few:
            small.append((base, lo, hi, wanted))
            continue
        inside = values.filter(F.col(column).between(lo, hi))
        bin_ = F.least(F.floor((F.col(column) - lo) / ((hi - lo) / BINS)), F.lit(BINS - 1))
        counted = sorted(inside.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("least"), F.max(column).alias("most")).collect())
        for row in counted:
            own = [r for r in wanted if base <= r < base + row.n]
            if own:
                todo.append((base, row.n, row.least, row.most, own))
            base += row.n
    if small:  # all of them in one pass
        inside = [F.sort_array(F.collect_list(F.when(F.col(column).between(lo, hi), F.col(column)))) for _, lo, hi, _ in small]
        lists = values.agg(*[x.alias(f"l{i}") for i, x in enumerate(inside)])
        picked = lists.select(*[F.get(f"l{i}", r - base).alias(f"v{i}_{r}") for i, (base, _, _, wanted) in enumerate(small) for r in wanted]).first()
        out |= {r: picked[f"v{i}_{r}"] for i, (_, _, _, wanted) in enumerate(small) for r in wanted}
    return out


def exact_quantiles(df: DataFrame, columns: Sequence[str | Column], probabilities: Sequence[float], interpolation: str | Sequence[str] = "nearest") -> dict[str, list[float | None]]:
    """Quantiles of each column's non-null values; None for a column without any. ``interpolation`` is one kind, or one for each
    of the probabilities. A column can be an expression, if it has a name."""
    kinds = [interpolation] * len(probabilities) if isinstance(interpolation, str) else list(interpolation)
    chosen = df.select(*columns)
    names = chosen.columns
    values = chosen.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(names)]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        row = values.agg(*[f(f"c{i}").alias(f"{name}_{i}") for i in range(len(names)) for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
        out: dict[str, list[float | None]] = {}
        for i, c in enumerate(names):
            n = row[f"n_{i}"]
            if not n:
                out[c] = [None] * len(probabilities)
                continue
            needs = [ranks_of(n, q, kind) for q, kind in zip(probabilities, kinds, strict=True)]
            found = order_statistics(values, f"c{i}", n, row[f"lo_{i}"], row[f"hi_{i}"], [r for ranks, _ in needs for r in ranks])
            out[c] = [found[r[0]] if len(r) == 1 else found[r[0]] + (found[r[1]] - found[r[0]]) * w for r, w in needs]
        return out
    finally:
        values.unpersist()


def iqr_threshold(df: DataFrame, column: str, multiplier: float = 1.5, interpolation: str = "nearest") -> float | None:
    """Third quartile plus so many interquartile ranges; None without values."""
    q1, q3 = exact_quantiles(df, [column], [0.25, 0.75], interpolation)[column]
    return None if q1 is None else q3 + multiplier * (q3 - q1)


def point_thresholds(df: DataFrame, multiplier: float = 1.5, mode: str = "occupied", interpolation: str | None = None, order: list[str] | None = None) -> tuple[float | None, float | None]:
    """Thresholds of time gap (s) and implied speed (km/h).

    ``occupied``: features between occupied points alone, nearest quantiles. ``contiguous``: features over all points,
    taken where a point and the one before are both occupied, linear quantiles.
    """
    if mode == "occupied":
        points = add_implied_speed(add_time_distance(occupied(df), order))
    elif mode == "contiguous":
        points = contiguous_occupied(add_implied_speed(add_time_distance(df, order)), order)
    else:
        raise ValueError(f"mode must be occupied or contiguous, not {mode!r}")
    how = interpolation or ("nearest" if mode == "occupied" else "linear")
    found = exact_quantiles(points, ["time_diff_seconds", "implied_speed_kph"], [0.25, 0.75], how)
    return tuple(None if q1 is None else q3 + multiplier * (q3 - q1) for q1, q3 in found.values())


#: Percentiles reported of all values, of those within the threshold, and of those beyond.
TIERS = {"raw": [90.0, 95.0, 97.5, 99.0, 99.5, 99.9], "clean": [90.0, 95.0, 97.5], "outlier": [90.0, 95.0]}


def percentile_tiers(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """(tier, percentile, value) with linear interpolation; a tier without values has null values."""
    spark = df.sparkSession
    value = F.col(column)
    parts = {"raw": value, "clean": F.when(value <= threshold, value), "outlier": F.when(value > threshold, value)}
    every = sorted({p for ps in TIERS.values() for p in ps})
    found = exact_quantiles(df, [part.alias(tier) for tier, part in parts.items()], [p / 100 for p in every], "linear")
    return spark.createDataFrame([(tier, p, found[tier][every.index(p)]) for tier, ps in TIERS.items() for p in ps], "tier string, percentile double, value double")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(statistic, one column each): count, null_count, mean, std (of a sample), min, 25%, 50%, 75% (nearest), max."""
    spark = df.sparkSession
    stats = {"count": F.count, "null_count": lambda c: F.count_if(F.col(c).isNull()), "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = df.agg(*[f(c).cast("double").alias(f"{s}_{i}") for i, c in enumerate(columns) for s, f in stats.items()]).first()
    quarters = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    names = ["count", "null_count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    value = lambda s, i, c: quarters[c][int(s[:-1]) // 25 - 1] if s.endswith("%") else row[f"{s}_{i}"]
    return spark.createDataFrame([(s, *[value(s, i, c) for i, c in enumerate(columns)]) for s in names], "statistic string, " + ", ".join(f"`{c}` double" for c in columns))


def bucket(value: Column, low: float, high: float, bins: int) -> Column:
    """Equal-width bin from 0; the last bin holds its upper edge too."""
    if high <= low:
        return F.lit(0)
    return F.least(F.width_bucket(value, F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins)) - 1


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, low, high, n) of the non-null values; empty bins have n = 0, no values give no bins."""
    spark = df.sparkSession
    values = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    low, high = values.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return spark.createDataFrame([], "bin int, low double, high double, n bigint")
    counts = values.groupBy(bucket(F.col("v"), low, high, bins).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (high - low) / bins
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin"), (low + F.col("id") * width).alias("low"), (low + (F.col("id") + 1) * width).alias("high"))
    return edges.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def counts_per_timestamp(df: DataFrame, column: str = "timestamp") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("len"))


def time_histogram(df: DataFrame, bins: int, column: str = "timestamp") -> DataFrame:
    """(bin, n): points by equal spans of time between the first and the last, from per-timestamp counts."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column))
    counts = counts_per_timestamp(df.filter(F.col(column).isNotNull()), column).select(micros.alias("at"), "len")
    low, high = counts.agg(F.min("at"), F.max("at")).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, n bigint")
    span = max(high - low, 1)
    place = F.least(F.expr(f"(at - {low}L) * {bins}L div {span}L"), F.lit(bins - 1))
    return counts.groupBy(place.cast("int").alias("bin")).agg(F.sum("len").alias("n"))
