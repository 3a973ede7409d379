"""Polygons as edges, from WKT, GeoJSON, shapefiles, or a table of edges. Boundaries are small; they are read on the driver."""

from __future__ import annotations

import json
import re
import struct

from pyspark.sql import DataFrame, SparkSession

from tracklake.functions.geodesy import Edge

MOST_EDGES = 100_000


def ring_edges(points: list[tuple[float, float]]) -> list[Edge]:
    """A ring's edges; it is closed if it isn't, and edges without length are left out."""
    closed = [*points, points[0]] if points and points[0] != points[-1] else points
    return [(*a, *b) for a, b in zip(closed, closed[1:], strict=False) if a != b]


def from_wkt(text: str) -> list[Edge]:
    """Edges of all rings of a POLYGON or MULTIPOLYGON."""
    if not re.match(r"\s*(SRID=\d+;)?\s*(MULTI)?POLYGON", text, re.I):
        raise ValueError("only POLYGON and MULTIPOLYGON are supported")
    rings = re.findall(r"\(([^()]+)\)", text)
    return [e for r in rings for e in ring_edges([tuple(map(float, p.split()[:2])) for p in r.split(",")])]


def from_geojson(text: str) -> list[Edge]:
    """Edges of all rings of a geometry, a feature or a collection."""
    found: list[Edge] = []

    def walk(o: dict) -> None:
        for part in o.get("features", []) + o.get("geometries", []):
            walk(part)
        if isinstance(o.get("geometry"), dict):
            walk(o["geometry"])
        if o.get("type") in ("Polygon", "MultiPolygon"):
            polygons = [o["coordinates"]] if o["type"] == "Polygon" else o["coordinates"]
            for ring in (r for p in polygons for r in p):
                found.extend(ring_edges([(float(p[0]), float(p[1])) for p in ring]))

    walk(json.loads(text))
    return found


def from_table(edges: DataFrame) -> list[Edge]:
    """Edges of a table with x1, y1, x2, y2; more than MOST_EDGES are refused."""
    rows = edges.select("x1", "y1", "x2", "y2").limit(MOST_EDGES + 1).collect()
    if len(rows) > MOST_EDGES:
        raise ValueError(f"a polygon of more than {MOST_EDGES} edges is too large for one expression")
    return [tuple(map(float, r)) for r in rows]


def shape_rings(data: bytes) -> list[list[list[tuple[float, float]]]]:
    """The rings of each record of a .shp file; records that are no polygons have none."""
    out, at = [], 100
    while at + 8 <= len(data):
        size = 2 * struct.unpack(">i", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        at += 8 + size
        rings = []
        if struct.unpack("<i", body[:4])[0] in (5, 15, 25):
            parts, points = struct.unpack("<2i", body[36:44])
            first = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            flat = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            xy = list(zip(flat[::2], flat[1::2], strict=True))
            rings = [xy[a:b] for a, b in zip(first, first[1:], strict=False)]
        out.append(rings)
    return out


def table_rows(data: bytes, encoding: str = "utf-8") -> list[dict[str, str]]:
    """The records of a .dbf file as text."""
    n, head, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("ascii"), data[at + 16]))
        at += 32
    out = []
    for i in range(n):
        own, row = head + i * size + 1, {}
        for name, width in fields:
            row[name] = data[own : own + width].decode(encoding, "replace").strip()
            own += width
        out.append(row)
    return out


def from_shapefile(spark: SparkSession, path: str, field: str | None = None, value: str | None = None) -> list[Edge]:
    """Edges of a .shp file's polygons; with ``field``, of those whose attribute in the .dbf beside it has this value.

    Coordinates are taken as longitude and latitude; other reference systems are not converted.
    """
    read = lambda p: bytes(spark.read.format("binaryFile").load(p).first().content)
    shapes = shape_rings(read(path))
    if field is not None:
        rows = table_rows(read(re.sub(r"\.shp$", ".dbf", path)))
        shapes = [s for s, r in zip(shapes, rows, strict=True) if r[field] == value]
    return [e for rings in shapes for ring in rings for e in ring_edges(ring)]
