"""Isolation forest over motion features: fitted on a bounded sample, scored in Arrow batches.

The forest follows the published algorithm: random splits isolate odd points in few steps. Each tree sees 256 rows of
a sample taken by a hash of the row key, which depends on neither partitioning nor order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.operators.features import TIE, motion
from tracklake.operators.quantiles import exact_quantiles
from tracklake.operators.staging import stage
from tracklake.schema import PLATE, TIME

FEATURES = ["speed", "acceleration", "direction_change"]
ROWS_PER_TREE = 256
EULER = 0.5772156649015329


@dataclass
class Forest:
    """Trees as arrays: feature to split by (-1 at a leaf), threshold, children; at a leaf the length of a path to it."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    usual: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Minus the anomaly score of each row: the lower, the odder."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(self.feature.shape[0]):
            at = np.zeros(len(x), np.int64)
            live = rows
            while len(live):
                f = self.feature[t, at[live]]
                live = live[f >= 0]
                f = f[f >= 0]
                goes_left = x[live, f] <= self.threshold[t, at[live]]
                at[live] = np.where(goes_left, self.left[t, at[live]], self.right[t, at[live]])
            total += self.length[t, at]
        return -np.power(2.0, -total / self.feature.shape[0] / self.usual)


def usual_length(n: int) -> float:
    """Mean path length of an unsuccessful search in a random binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def fit_forest(x: np.ndarray, trees: int, seed: int, rows_per_tree: int = ROWS_PER_TREE) -> Forest:
    rng = np.random.default_rng(seed)
    size = min(rows_per_tree, len(x))
    depth = int(np.ceil(np.log2(max(size, 2))))
    most = 2 ** (depth + 1)
    feature, left, right = np.full((trees, most), -1), np.zeros((trees, most), np.int64), np.zeros((trees, most), np.int64)
    threshold, length = np.zeros((trees, most)), np.zeros((trees, most))
    for t in range(trees):
        todo = [(0, x[rng.choice(len(x), size, replace=False)], 0)]
        used = 1
        while todo:
            node, own, level = todo.pop()
            low, high = own.min(axis=0), own.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if level == depth or len(own) < 2 or not len(open_):
                length[t, node] = level + usual_length(len(own))
                continue
            f = rng.choice(open_)
            cut = min(rng.uniform(low[f], high[f]), np.nextafter(high[f], low[f]))  # rounding may reach the upper end
            goes_left = own[:, f] <= cut
            feature[t, node], threshold[t, node], left[t, node], right[t, node] = f, cut, used, used + 1
            todo += [(used, own[goes_left], level + 1), (used + 1, own[~goes_left], level + 1)]
            used += 2
    return Forest(feature, threshold, left, right, length, max(usual_length(size), 1e-9))


def detect_outliers(df: DataFrame, contamination: float = 0.05, seed: int = 42, trees: int = 100, order: list[str] | None = None) -> DataFrame:
    """The points with is_outlier: -1 for the given share of odd motion, else 1. Points without a full set of features are 1.

    The sample that reaches the driver has at most ``trees * 256`` rows, those with the least hash of their key.
    """
    points = motion(df, order)
    whole = F.lit(True)
    for c in FEATURES:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    key = F.xxhash64(PLATE, TIME, *([TIE] if TIE in df.columns else []), F.lit(seed))
    sample = points.filter(whole).select(*[F.col(c).cast("double") for c in FEATURES], key.alias("h_")).orderBy("h_", *FEATURES).limit(trees * ROWS_PER_TREE).drop("h_").collect()
    if not sample:
        return points.drop(*FEATURES).withColumn("is_outlier", F.lit(1))
    forest = fit_forest(np.array(sample, float), trees, seed)

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.column_stack([a, b, c])))

    # Staged, as the limit is found in one reading of the scores and applied in another.
    scored = points.withColumn("score_", F.when(whole, score(*[F.when(whole, F.col(c)).otherwise(0.0) for c in FEATURES])))
    scored = stage(scored.drop(*FEATURES))
    limit = exact_quantiles(scored, ["score_"], [contamination], "linear")["score_"][0]
    return scored.withColumn("is_outlier", F.when(F.col("score_") < limit, -1).otherwise(1)).drop("score_")
