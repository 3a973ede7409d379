from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.operators import features, periods, profiling, quantiles
from tracklake.operators.outliers import detect_outliers

T0 = datetime(2023, 1, 1)


@pytest.fixture(scope="module")
def four(spark):
    rows = [("A", T0, 0.0, 0.0), ("A", T0 + timedelta(seconds=5), 1.0, 0.0), ("B", T0, 45.0, 0.0), ("B", T0 + timedelta(seconds=1), 45.001, 0.0)]
    return spark.createDataFrame(rows, "license_plate string, timestamp timestamp_ntz, latitude double, longitude double")


def test_time_and_distance(four):
    rows = features.add_time_distance(four).orderBy("license_plate", "timestamp").collect()
    assert [r.time_diff_seconds for r in rows] == [None, 5, None, 1]
    assert [r.distance_km for r in rows] == pytest.approx([0, 111.195, 0, 0.11119], rel=1e-2)
    assert rows[1].distance_km == pytest.approx(111.195, rel=1e-3)
    assert rows[1].time_diff_duration == timedelta(seconds=5)


def test_one_shuffle_serves_all_lags(four):
    plan = features.add_implied_speed(features.add_time_distance(four))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize(("s", "km", "kph"), [(5, 1.0, 720.0), (0, 1.0, 0.0), (3600, 100.0, 100.0), (None, 3.0, 0.0)])
def test_speed(spark, s, km, kph):
    df = spark.createDataFrame([(s, km)], "time_diff_seconds bigint, distance_km double")
    assert features.add_implied_speed(df).first().implied_speed_kph == pytest.approx(kph)


def test_flags(four):
    made = features.add_flags(features.add_implied_speed(features.add_time_distance(four)), 4.0, 100.0)
    rows = made.orderBy("license_plate", "timestamp").collect()
    assert [r.is_temporal_gap for r in rows] == [None, True, None, False]
    assert [r.is_position_jump for r in rows] == [False, True, False, True]
    assert features.anomalous(made).count() == 2


def test_iqr(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 3, 4, 100]], "x bigint")
    assert quantiles.iqr_threshold(df, "x") == 7.0
    rows = [("A", T0 + timedelta(minutes=i), 0.0, 0.0, o) for i, o in enumerate([1, 1, 1, 1, 1, 0])]
    points = spark.createDataFrame(rows, "license_plate string, timestamp timestamp_ntz, latitude double, longitude double, occupancy_status bigint")
    assert quantiles.point_thresholds(points) == (60.0, 0.0)
    assert quantiles.point_thresholds(points, mode="contiguous") == (60.0, 0.0)
    assert quantiles.point_thresholds(points.limit(0)) == (None, None)


def test_both_interpolations(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4]], "x double")
    assert quantiles.exact_quantiles(df, ["x"], [0.25], "nearest")["x"] == [2.0]
    assert quantiles.exact_quantiles(df, ["x"], [0.25], "linear")["x"] == [1.75]


def test_order_statistics_by_counting(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25), rng.exponential(1e6, 500)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    ranks = [0, 1, 17, 2500, 3333, 4998, 4999]
    found = quantiles.order_statistics(df, "x", len(x), float(x.min()), float(x.max()), ranks, few=50)
    assert [found[r] for r in ranks] == np.sort(x)[ranks].tolist()


def test_histogram_like_numpy(spark):
    x = np.random.default_rng(2).normal(size=2000)
    rows = quantiles.histogram(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", 20).orderBy("bin").collect()
    assert [r.n for r in rows] == np.histogram(x, 20)[0].tolist()
    same = quantiles.histogram(spark.createDataFrame([(3.0,)] * 4, "x double"), "x", 5)
    assert same.agg(F.sum("n")).first()[0] == 4
    assert quantiles.histogram(spark.createDataFrame([(None,)], "x double"), "x", 5).count() == 0


def test_profile(spark):
    rows = [(1, "a", datetime(2023, 1, 1)), (2, "a", datetime(2023, 1, 2)), (3, "b", None), (None, None, None), (5, "c", datetime(2023, 1, 3))]
    df = spark.createDataFrame(rows, "numeric bigint, string string, date timestamp_ntz")
    got = profiling.profile_as_dict(df)
    assert (got["numeric"]["missing_count"], got["numeric"]["missing_pct"], got["numeric"]["unique"]) == (1, 20.0, 5)
    assert (got["string"]["missing_count"], got["string"]["unique"], got["date"]["missing_count"]) == (1, 4, 2)
    assert profiling.profile(df.limit(0)).count() == 0
    assert list(profiling.profile_as_dict(df, ["numeric"])) == ["numeric"]
    with pytest.raises(ValueError, match="Columns not found"):
        profiling.profile(df, ["nope"])


POINT = "license_plate string, timestamp timestamp_ntz, latitude double, longitude double, occupancy_status string, implied_speed_kph double, time_diff_seconds bigint, distance_km double"


def test_periods_with_coordinates(spark):
    raw = [("A", 0, 39.90, 116.40, "1", 50.0, 0.5), ("A", 1, 39.91, 116.41, "1", 45.0, 0.45), ("A", 2, 39.92, 116.42, "0", 0.0, 0.0), ("A", 3, 39.93, 116.43, "0", 0.0, 0.0), ("B", 0, 40.00, 116.50, "0", 30.0, 0.3), ("B", 1, 40.01, 116.51, "1", 120.0, 1.2)]
    df = spark.createDataFrame([(p, T0 + timedelta(microseconds=u), a, o, s, k, 60, d) for p, u, a, o, s, k, d in raw], POINT)
    made = periods.add_period_id(df)
    assert [r.period_id for r in made.orderBy("license_plate", "timestamp").collect()] == [1, 1, 2, 2, 3, 4]
    rows = {r.period_id: r for r in periods.summarize_periods(made).collect()}
    assert rows[1].duration == timedelta(microseconds=1)
    assert (rows[1].count_rows, rows[1].avg_implied_speed, rows[2].avg_implied_speed) == (2, 47.5, 0.0)
    assert rows[1].sum_time_diff == 120 and rows[3].straight_line_distance_km == 0.0 and rows[3].sld_ratio == 0.0


def test_periods_without_coordinates(spark):
    status = {"A": "11010", "B": "00100"}
    df = spark.createDataFrame([(p, T0 + timedelta(seconds=i), o, 1.0, 1, 0.1) for p, s in status.items() for i, o in enumerate(s)], "license_plate string, timestamp timestamp_ntz, occupancy_status string, implied_speed_kph double, time_diff_seconds bigint, distance_km double")
    made = periods.add_period_id(df)
    ids = lambda p: {r.period_id for r in made.filter(F.col("license_plate") == p).collect()}
    assert ids("A") == {1, 2, 3, 4} and ids("B") == {5, 6, 7}
    out = periods.summarize_periods(made)
    assert "sld_ratio" not in out.columns and out.agg(F.sum("count_rows")).first()[0] == 10
    assert periods.summarize_periods(periods.add_period_id(df.limit(0))).count() == 0


def test_period_ids_in_a_given_order(spark):
    df = spark.createDataFrame([(i, p, "1") for i, p in enumerate("AABBA")], "row bigint, license_plate string, occupancy_status string")
    assert [r.period_id for r in periods.add_period_id_in_order(df, "row").orderBy("row").collect()] == [1, 1, 2, 2, 3]


def test_null_status_starts_periods(spark):
    df = spark.createDataFrame([("A", T0 + timedelta(seconds=i), o) for i, o in enumerate([1, None, None, 1])], "license_plate string, timestamp timestamp_ntz, occupancy_status int")
    assert [r.period_id for r in periods.add_period_id(df).orderBy("timestamp").collect()] == [1, 2, 3, 4]


def test_attach_counts_shared_bounds_twice(spark):
    at = lambda h: T0 + timedelta(hours=h)
    points = spark.createDataFrame([("A", at(h)) for h in (0, 30, 60, 61, 99)] + [("B", at(0))], "license_plate string, timestamp timestamp_ntz")
    rows = spark.createDataFrame([("A", 1, at(0), at(60)), ("A", 2, at(60), at(70))], "license_plate string, period_id int, start_time timestamp_ntz, end_time timestamp_ntz")
    got = sorted((r.timestamp, r.period_id) for r in periods.attach_period_id(points, rows).collect())
    assert got == [(at(0), 1), (at(30), 1), (at(60), 1), (at(60), 2), (at(61), 2)]


def test_no_threshold_no_flag(spark):
    rows = spark.createDataFrame([], "license_plate string, period_id int, sld_ratio double")
    assert periods.add_detour_flag(rows).count() == 0


def test_model_without_features_flags_nothing(spark):
    df = spark.createDataFrame([("A", T0, float(i), float(i)) for i in range(3)], "license_plate string, timestamp timestamp_ntz, latitude double, longitude double")
    assert [r.is_outlier for r in detect_outliers(df).collect()] == [1, 1, 1]


def test_model_finds_jumps(spark):
    rows, jumps = [], set(range(100, 1000, 90))
    for i in range(1000):
        rows.append(("A", T0 + timedelta(seconds=10 * i), 40 + i * 1e-4 + (0.5 if i in jumps else 0), 116 + (i % 7) * 1e-5, i))
    df = spark.createDataFrame(rows, "license_plate string, timestamp timestamp_ntz, latitude double, longitude double, key bigint")
    made = {r.key: r.is_outlier for r in detect_outliers(df, contamination=0.05).collect()}
    assert len(made) == 1000
    assert all(made[i] == -1 for i in jumps)
    assert 0.03 <= sum(v == -1 for v in made.values()) / 1000 <= 0.06


def test_period_ids_in_a_given_order_over_ranges(spark):
    """As a plain loop over the rows counts them, with nulls, over many ranges."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([0, 1, None])) for i in range(500)]
    df = spark.createDataFrame(rows, "row int, license_plate string, occupancy_status int")
    want, n, last = {}, 0, None
    for i, plate, status in rows:
        n += last is None or None in (plate, status, *last) or (plate, status) != last
        want[i], last = n, (plate, status)
    assert {r.row: r.period_id for r in periods.add_period_id_in_order(df.repartition(3), "row").collect()} == want
    assert periods.add_period_id_in_order(df.limit(0), "row").isEmpty()
