from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from tracklake.plans import cleaning, study
from tracklake.plans.adapter import read_points
from tracklake.sources import csv_points, memory, parquet
from tracklake.streaming import tracks

ROWS = """c,t,京A12345,2019-11-25 01:02:03,116.1,39.9,30.5,1,x,y,z
c,t,京A12345,2019-11-25 01:02:04,N,n,,999,x,y,z
c,t,N,bad,116.x,39.9,1,0,x,y,z
"""


@pytest.fixture
def raw(tmp_path):
    path = tmp_path / "day.csv"
    path.write_text(ROWS, encoding="utf-8")
    return str(path)


def test_read_csv(spark, raw):
    rows = csv_points.read_points(spark, raw).collect()
    assert tuple(rows[0]) == ("京A12345", datetime(2019, 11, 25, 1, 2, 3), 116.1, 39.9, 30.5, 1)
    assert tuple(rows[1])[2:] == (None, None, None, None)
    assert tuple(rows[2]) == (None, None, None, 39.9, 1.0, 0)
    assert csv_points.read_points(spark, raw, "taxi_id, license_plate").columns == ["taxi_id", "license_plate"]
    assert csv_points.read_points(spark, raw, ["timestamp"], "yyyy-MM-dd HH:mm:ss").first()[0] == datetime(2019, 11, 25, 1, 2, 3)
    with pytest.raises(ValueError, match="unknown columns"):
        csv_points.read_points(spark, raw, ["nope"])


@pytest.mark.parametrize("codec", parquet.CODECS)
def test_convert(spark, raw, tmp_path, codec):
    where = csv_points.convert_csv(spark, raw, str(tmp_path / codec), codec, single_file=True)
    assert spark.read.parquet(where).count() == 3
    with pytest.raises(FileNotFoundError):
        csv_points.convert_csv(spark, raw + "x")
    with pytest.raises(ValueError, match="compression"):
        csv_points.convert_csv(spark, raw, str(tmp_path / "no"), "zip")


def test_save_counts_rows(spark, tmp_path):
    assert parquet.save_parquet(spark.range(7), str(tmp_path / "t")) == 7


def test_flow_and_study(spark, tmp_path):
    points = read_points(spark, "/root/testdata/sf0.001")
    out = cleaning.run(points, multiplier=20.0, output=str(tmp_path / "out"))
    assert out.points.select("license_plate").distinct().count() == 7
    assert out.points.count() == 451 and out.periods.count() == 48
    assert spark.read.parquet(str(tmp_path / "out" / "periods")).count() == 48
    assert len(study.threshold_study(points, str(tmp_path / "study"))) == 16


def test_stream_matches_batch(spark, tmp_path):
    t0 = datetime(2023, 1, 1)
    rows = [(p, t0 + timedelta(seconds=s), 116.0 + s / 1000, 40.0, 1) for p in "AB" for s in (0, 5, 9, 30)]
    schema = "license_plate string, timestamp timestamp_ntz, longitude double, latitude double, occupancy_status int"
    for i in range(2):
        spark.createDataFrame([r for r in rows if (r[1] > t0 + timedelta(seconds=7)) == bool(i)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    points = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "in"))
    run = tracks.stream_flags(points, 10, 1000).writeStream.format("memory").queryName("made").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    got = spark.table("made").orderBy("license_plate", "timestamp").collect()
    assert [r.time_diff_seconds for r in got] == [None, 5, 4, 21] * 2
    assert [r.is_temporal_gap for r in got] == [None, False, False, True] * 2
    counted = tracks.counts_by_window(spark.createDataFrame(rows, schema), "10 seconds").orderBy("start").collect()
    assert [r.n for r in counted] == [6, 2]


def test_points_from_columns(spark):
    rows = memory.points_from_columns(spark, {"license_plate": ["A", "B"], "timestamp": ["2019-11-25T01:02:03", "bad"], "latitude": [1.0, 2.0]}).collect()
    assert [r.timestamp for r in rows] == [datetime(2019, 11, 25, 1, 2, 3), None]
