from __future__ import annotations

import struct
from datetime import date, datetime

import pytest

from tracklake.functions.geodesy import within_edges
from tracklake.functions.plates import plate_state
from tracklake.operators import filters
from tracklake.sources import polygons


def plates(df):
    return sorted(r.license_plate for r in df.collect())


def test_plates(spark):
    good = ["京A12345", "粤B12345", "沪C1234D", "苏E1234F"]
    bad = ["京A1234", "粤B123456", "invalid", None, "京I12345", "京AO2345", "京a12345", "京A12345\n", "京AD12345"]
    df = spark.createDataFrame([(p,) for p in good + bad], "license_plate string")
    assert plates(filters.valid_plates(df)) == sorted(good)
    assert plates(filters.valid_plates(df, allow_new_energy=True)) == sorted([*good, "京AD12345"])


@pytest.mark.parametrize(
    ("days", "given", "want"),
    [
        (["2018-01-01", "2019-01-01", "2019-12-31", "2020-01-01"], {}, 2),
        (["2019-01-01", "2019-06-15", "2019-12-31", "2020-01-01"], {"start": date(2019, 6, 1), "end": date(2019, 6, 30)}, 1),
        (["2019-01-01", "2019-01-02", "2019-01-03"], {"start": date(2019, 1, 2), "end": date(2019, 1, 2)}, 1),
        (["2019-01-01", "2019-02-01", "2019-02-15", "2019-03-01"], {"start": date(2019, 2, 1), "end": date(2019, 2, 28)}, 2),
        (["2018-12-31", "2019-01-01", "2019-12-31", "2020-01-01"], {"year": 2019, "start": date(2019, 1, 1), "end": date(2019, 12, 31)}, 2),
        ([], {}, 0),
    ],
)
def test_dates(spark, days, given, want):
    df = spark.createDataFrame([(datetime.fromisoformat(d),) for d in days], "timestamp timestamp_ntz")
    assert filters.by_date(df, **given).count() == want


def test_date_errors(spark):
    df = spark.createDataFrame([("2019",)], "timestamp string")
    with pytest.raises(ValueError, match="not found"):
        filters.by_date(df, "other")
    with pytest.raises(ValueError, match="must be a datetime or date type"):
        filters.by_date(df)


def test_box_has_its_border(spark):
    df = spark.createDataFrame([(115.7, 39.4), (117.4, 41.6), (115.69, 40.0), (116.0, 41.61), (None, 40.0)], "longitude double, latitude double")
    assert filters.in_box(df).count() == 2


def brute_inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return False
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def test_polygon_with_a_hole_and_two_parts(spark):
    rings = [[(0, 0), (8, 0), (8, 8), (0, 8)], [(2, 2), (4, 2), (4, 4), (2, 4)], [(10, 0), (12, 0), (11, 3)]]
    wkt = "MULTIPOLYGON(((0 0,8 0,8 8,0 8,0 0),(2 2,4 2,4 4,2 4,2 2)),((10 0,12 0,11 3,10 0)))"
    edges = polygons.from_wkt(wkt)
    assert len(edges) == 11
    grid = [(x / 2, y / 2) for x in range(-2, 27) for y in range(-2, 19)]
    df = spark.createDataFrame(grid, "longitude double, latitude double")
    assert {tuple(r) for r in filters.in_polygon(df, edges).collect()} == {p for p in grid if brute_inside(*p, rings)}
    one = df.select(within_edges(df.longitude, df.latitude, edges).alias("i"))
    assert one.filter("i").count() == sum(brute_inside(*p, rings) for p in grid)


def test_polygon_sources(spark):
    geo = '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[0,1],[0,0]]]}}]}'
    want = [(0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 0.0, 1.0), (0.0, 1.0, 0.0, 0.0)]
    assert polygons.from_geojson(geo) == want == polygons.from_wkt("POLYGON((0 0,1 0,0 1))")
    assert sorted(polygons.from_table(spark.createDataFrame(want, "x1 double, y1 double, x2 double, y2 double"))) == sorted(want)
    with pytest.raises(ValueError, match="POLYGON"):
        polygons.from_wkt("POINT(1 2)")


def test_without_plates_is_null_safe(spark):
    df = spark.createDataFrame([("A",), ("B",), (None,)], "license_plate string")
    listed = spark.createDataFrame([("B",), (None,)], "license_plate string")
    assert plates(filters.without_plates(df, listed)) == ["A"]


def test_privacy_state():
    hashed = {"A": "ha", "B": "hb", "C": "hc"}
    names, shown = ["A", "B", "C"], ["ha", "hb", "hc"]
    assert plate_state(True, names, shown, "A", hashed) == "ha"
    assert plate_state(True, names, shown, "Z", hashed) == "ha"
    assert plate_state(False, names, shown, "hb", hashed) == "B"
    assert plate_state(False, names, shown, "Z", hashed) == "A"


def test_shapefile(spark, tmp_path):
    squares = {"North": [[(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (0.0, 0.0)], [(0.5, 0.5), (1.0, 0.5), (1.0, 1.0), (0.5, 0.5)]], "South": [[(5.0, 5.0), (5.0, 6.0), (6.0, 6.0), (5.0, 5.0)]]}
    shp, dbf = b"\0" * 100, b""
    for i, (name, rings) in enumerate(squares.items()):
        points = [p for r in rings for p in r]
        first = [sum(map(len, rings[:k])) for k in range(len(rings))]
        body = struct.pack("<i4d2i", 5, 0, 0, 0, 0, len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *first) + b"".join(struct.pack("<2d", *p) for p in points)
        shp += struct.pack(">2i", i + 1, len(body) // 2) + body
        dbf += b" " + name.encode().ljust(10)
    (tmp_path / "a.shp").write_bytes(shp)
    (tmp_path / "a.dbf").write_bytes(b"\3\0\0\0" + struct.pack("<IHH", 2, 65, 11) + b"\0" * 20 + b"NAME_1".ljust(11, b"\0") + b"C\0\0\0\0" + bytes([10]) + b"\0" * 15 + b"\r" + dbf)
    assert polygons.from_shapefile(spark, str(tmp_path / "a.shp"), "NAME_1", "North") == [e for r in squares["North"] for e in polygons.ring_edges(r)]
    assert len(polygons.from_shapefile(spark, str(tmp_path / "a.shp"))) == 10


def test_join_polygons(spark):
    square = lambda a, b: [(a, a, b, a), (b, a, b, b), (b, b, a, b), (a, b, a, a)]
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0), (3, 5.0, 5.0), (4, None, 1.0), (5, 9.0, 9.0), (2, 3.0, 3.0)], "id int, longitude double, latitude double")
    shapes = [({"area": "a"}, square(0.0, 4.0)), ({"area": "b"}, square(2.0, 6.0))]
    found = sorted((r.id, r.area) for r in filters.join_polygons(points, shapes).collect())
    assert found == [(1, "a"), (2, "a"), (2, "a"), (2, "b"), (2, "b"), (3, "b")]
    assert filters.join_polygons(points, []).isEmpty() and filters.join_polygons(points.limit(0), shapes).isEmpty()
    with pytest.raises(ValueError, match="columns of the points"):
        filters.join_polygons(points.withColumn("area", points.id), shapes)
