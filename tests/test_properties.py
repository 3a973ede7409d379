from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracklake.functions.geodesy import haversine_km
from tracklake.operators import features, filters, periods

SOME = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
PLACE = st.tuples(st.floats(-90, 90), st.floats(-180, 180))


@SOME
@given(st.lists(st.tuples(PLACE, PLACE), min_size=1, max_size=30))
def test_distance_is_symmetric_and_bounded(spark, pairs):
    df = spark.createDataFrame([(*a, *b) for a, b in pairs], "a double, b double, c double, d double")
    rows = df.select(haversine_km(df.a, df.b, df.c, df.d).alias("x"), haversine_km(df.c, df.d, df.a, df.b).alias("y"), haversine_km(df.a, df.b, df.a, df.b).alias("z")).collect()
    for r in rows:
        assert r.x == pytest.approx(r.y, abs=1e-6) and 0 <= r.x <= 20016 and r.z == 0


@SOME
@given(st.lists(st.tuples(st.sampled_from("ABC"), st.integers(0, 50), st.sampled_from([0, 1, None])), max_size=40))
def test_periods_partition_the_points(spark, raw):
    t0 = datetime(2023, 1, 1)
    rows = [(p, t0 + timedelta(seconds=s), i, o, 1.0, 1, 0.5) for i, (p, s, o) in enumerate(raw)]
    df = spark.createDataFrame(rows, "license_plate string, timestamp timestamp_ntz, key int, occupancy_status int, implied_speed_kph double, time_diff_seconds bigint, distance_km double")
    made = periods.add_period_id(df)
    want, last = {}, None
    for n in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        new = last is None or n[0] != last[0] or n[3] is None or last[3] is None or n[3] != last[3]
        want[n[2]] = (want[last[2]] if last else 0) + new
        last = n
    assert {r.key: r.period_id for r in made.collect()} == want
    out = periods.summarize_periods(made)
    assert (out.agg(F.sum("count_rows")).first()[0] or 0) == len(rows) and out.count() == len(set(want.values()))


@SOME
@given(st.lists(st.tuples(st.sampled_from(["A", "B", "C", None]), st.booleans(), st.one_of(st.none(), st.booleans())), max_size=30))
def test_removed_and_kept_plates_cover_all(spark, raw):
    df = spark.createDataFrame(raw, "license_plate string, is_position_jump boolean, is_temporal_gap boolean")
    bad = features.anomalous(df).select("license_plate").distinct()
    kept = filters.without_plates(df, bad)
    names = {p for p, jump, gap in raw if jump or gap}
    assert sorted(r.license_plate for r in kept.collect()) == sorted(p for p, _, _ in raw if p is not None and p not in names)
