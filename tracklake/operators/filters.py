"""Row filters. All are predicates that Catalyst can push into the scan, but for the plate pattern and the polygon."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklake.functions.geodesy import Edge, within_edges
from tracklake.functions.plates import is_valid_plate
from tracklake.schema import PLATE, TIME


def valid_plates(df: DataFrame, column: str = PLATE, allow_new_energy: bool = False) -> DataFrame:
    return df.filter(is_valid_plate(F.col(column), allow_new_energy))


def by_date(df: DataFrame, column: str = TIME, year: int = 2019, start: date | datetime | None = None, end: date | datetime | None = None) -> DataFrame:
    """Rows within the bounds, both included; with no bound given, those of the year. A bound that is a date means its midnight."""
    if column not in df.columns:
        raise ValueError(f"column {column!r} not found in {df.columns}")
    if not isinstance(df.schema[column].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"column {column!r} must be a datetime or date type, not {df.schema[column].dataType.simpleString()}")
    if start is None and end is None:
        # A half-open range rather than year(column): it reaches the Parquet scan.
        return df.filter((F.col(column) >= moment(datetime(year, 1, 1))) & (F.col(column) < moment(datetime(year + 1, 1, 1))))
    if start is not None:
        df = df.filter(F.col(column) >= moment(start))
    if end is not None:
        df = df.filter(F.col(column) <= moment(end))
    return df


def moment(value: date | datetime):
    at = value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def on_day(df: DataFrame, day: date, column: str = TIME) -> DataFrame:
    """Rows from the day's midnight to its last microsecond."""
    first = datetime(day.year, day.month, day.day)
    return by_date(df, column, start=first, end=first + timedelta(days=1, microseconds=-1))


def last_hours(df: DataFrame, end: datetime, hours: float = 2, column: str = TIME) -> DataFrame:
    return by_date(df, column, start=end - timedelta(hours=hours), end=end)


def in_box(df: DataFrame, lon: tuple[float, float] = (115.7, 117.4), lat: tuple[float, float] = (39.4, 41.6), x: str = "longitude", y: str = "latitude") -> DataFrame:
    """Points within the box, its border included."""
    return df.filter(F.col(x).between(*lon) & F.col(y).between(*lat))


def in_polygon(df: DataFrame, edges: list[Edge], x: str = "longitude", y: str = "latitude") -> DataFrame:
    """Points strictly inside the polygon. Its bounding box, which the scan can use, is tried first."""
    xs, ys = [v for e in edges for v in (e[0], e[2])], [v for e in edges for v in (e[1], e[3])]
    return in_box(df, (min(xs), max(xs)), (min(ys), max(ys)), x, y).filter(within_edges(F.col(x), F.col(y), edges))


def join_polygons(df: DataFrame, polygons: list[tuple[dict[str, str], list[Edge]]], x: str = "longitude", y: str = "latitude") -> DataFrame:
    """The points strictly inside a polygon, with its attributes; one row for each polygon that a point lies in.

    All polygons have the same attributes, whose names must not be columns of the points. They are literals, so their edges
    together bound the expression's size. Points with a null coordinate lie in none; no polygons give no rows.
    """
    if not polygons:
        return df.limit(0)
    names = list(polygons[0][0])
    if clash := sorted(set(names) & set(df.columns)):
        raise ValueError(f"attributes {clash} are columns of the points")
    found = []
    for attributes, edges in polygons:
        xs, ys = [v for e in edges for v in (e[0], e[2])], [v for e in edges for v in (e[1], e[3])]
        inside = F.col(x).between(min(xs), max(xs)) & F.col(y).between(min(ys), max(ys)) & within_edges(F.col(x), F.col(y), edges)
        found.append(F.when(inside, F.struct(*[F.lit(attributes[n]).alias(n) for n in names])))
    xs, ys = [v for _, es in polygons for e in es for v in (e[0], e[2])], [v for _, es in polygons for e in es for v in (e[1], e[3])]
    near = in_box(df, (min(xs), max(xs)), (min(ys), max(ys)), x, y)
    return near.select(*df.columns, F.explode(F.array_compact(F.array(*found))).alias("polygon_")).select(*df.columns, *[F.col(f"polygon_.`{n}`").alias(n) for n in names])


def occupied(df: DataFrame, column: str = "occupancy_status") -> DataFrame:
    """Rows with status 1, whether it is stored as a number or as text."""
    return df.filter(F.col(column).cast("string") == "1")


def without_plates(df: DataFrame, plates: DataFrame, column: str = PLATE) -> DataFrame:
    """Rows whose plate is not among ``plates``; as with NOT IN over known values, rows without a plate go too."""
    listed = plates.select(column).filter(F.col(column).isNotNull()).distinct()
    return df.filter(F.col(column).isNotNull()).join(listed, column, "left_anti")
