"""Geometry over doubles and arrays. A ring is array<struct<x double, y double>>; a polygon is an array of rings; a box is
struct<west, south, east, north>. x is longitude and y latitude where it matters. Line simplification and polygon clipping walk
their input step by step and run as Arrow UDFs; everything else stays in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

RADIUS_SPHERE, RADIUS_EARTH, EQUATOR_M = 6378137.0, 6371000.0, 40075017.0
MAX_LATITUDE = 85.0511287798
POINTS = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.struct(west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north"))


def box_of(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def box_extend(a: Column, b: Column) -> Column:
    """The smallest box around both; a missing one doesn't count."""
    return box(F.least(a.west, b.west), F.least(a.south, b.south), F.greatest(a.east, b.east), F.greatest(a.north, b.north))


def box_contains_point(b: Column, x: Column, y: Column) -> Column:
    return (x >= b.west) & (x <= b.east) & (y >= b.south) & (y <= b.north)


def box_contains(a: Column, b: Column) -> Column:
    return (b.west >= a.west) & (b.east <= a.east) & (b.south >= a.south) & (b.north <= a.north)


def box_intersects(a: Column, b: Column) -> Column:
    """They share a point, if only of an edge."""
    return (b.east >= a.west) & (b.west <= a.east) & (b.north >= a.south) & (b.south <= a.north)


def box_overlaps(a: Column, b: Column) -> Column:
    """They share an area."""
    return (b.east > a.west) & (b.west < a.east) & (b.north > a.south) & (b.south < a.north)


def box_pad(b: Column, ratio: float) -> Column:
    dx, dy = F.abs(b.east - b.west) * ratio, F.abs(b.north - b.south) * ratio
    return box(b.west - dx, b.south - dy, b.east + dx, b.north + dy)


def box_center(b: Column) -> Column:
    return point((b.west + b.east) / 2, (b.south + b.north) / 2)


def box_around(lat: Column, lng: Column, meters: Column) -> Column:
    """A box of the given size around a point."""
    d_lat = 180 * meters / EQUATOR_M
    d_lng = d_lat / F.cos(F.radians(lat))
    return box(lng - d_lng, lat - d_lat, lng + d_lng, lat + d_lat)


def distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres along a great circle."""
    s_lat, s_lng = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lng2 - lng1) / 2)
    a = s_lat * s_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s_lng * s_lng
    return RADIUS_EARTH * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def planar_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def mercator(lat: Column, lng: Column) -> Column:
    """Spherical Mercator in metres; latitudes beyond the square map's are moved to its edge."""
    kept = F.greatest(F.lit(-MAX_LATITUDE), F.least(F.lit(MAX_LATITUDE), lat))
    s = F.sin(F.radians(kept))
    return point(RADIUS_SPHERE * F.radians(lng), RADIUS_SPHERE * F.ln((1 + s) / (1 - s)) / 2)


def mercator_inverse(x: Column, y: Column) -> Column:
    """struct<x: longitude, y: latitude>."""
    return point(F.degrees(x / RADIUS_SPHERE), F.degrees(2 * F.atan(F.exp(y / RADIUS_SPHERE)) - F.pi() / 2))


_MINOR = 6356752.314245179
_ECCENTRICITY = (1 - (_MINOR / RADIUS_SPHERE) ** 2) ** 0.5


def ellipsoidal_mercator(lat: Column, lng: Column) -> Column:
    s = F.sin(F.radians(lat)) * _ECCENTRICITY
    ts = F.tan(F.pi() / 4 - F.radians(lat) / 2) / F.pow((1 - s) / (1 + s), F.lit(_ECCENTRICITY / 2))
    return point(RADIUS_SPHERE * F.radians(lng), -RADIUS_SPHERE * F.ln(F.greatest(ts, F.lit(1e-10))))


def ellipsoidal_mercator_inverse(x: Column, y: Column, rounds: int = 15) -> Column:
    ts = F.exp(-y / RADIUS_SPHERE)

    def closer(phi: Column, _: Column) -> Column:
        s = _ECCENTRICITY * F.sin(phi)
        return F.pi() / 2 - 2 * F.atan(ts * F.pow((1 - s) / (1 + s), F.lit(_ECCENTRICITY / 2)))

    phi = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.pi() / 2 - 2 * F.atan(ts), closer)
    return point(F.degrees(x / RADIUS_SPHERE), F.degrees(phi))


def plate_carree(lat: Column, lng: Column) -> Column:
    return point(lng, lat)


#: Coordinate systems by name: projection and the affine step to the unit square (scale and offset of x, then of y).
CRS = {
    "EPSG3857": (mercator, (0.5 / (3.141592653589793 * RADIUS_SPHERE), 0.5, -0.5 / (3.141592653589793 * RADIUS_SPHERE), 0.5)),
    "EPSG3395": (ellipsoidal_mercator, (0.5 / (3.141592653589793 * RADIUS_SPHERE), 0.5, -0.5 / (3.141592653589793 * RADIUS_SPHERE), 0.5)),
    "EPSG4326": (plate_carree, (1 / 180, 1.0, -1 / 180, 0.5)),
    "Simple": (plate_carree, (1.0, 0.0, -1.0, 0.0)),
}


def crs_code(name: str | None) -> str:
    """Short code of a system's name: urn:ogc:def:crs:EPSG::3857 is EPSG:3857; L.CRS.EPSG3857 is EPSG3857. The default is EPSG3857."""
    if not name:
        return "EPSG3857"
    if name.lower().startswith("urn:"):
        parts = name.split(":")
        return f"{parts[-3]}:{parts[-1]}"
    return name.removeprefix("L.CRS.")


def pixel(lat: Column, lng: Column, zoom: Column, crs: str = "EPSG3857") -> Column:
    """Pixel of a place on the world map of a zoom level (256 times 2 to the zoom pixels wide, 2 to the zoom if Simple)."""
    project, (a, b, c, d) = CRS[crs_code(crs).replace(":", "")]
    p = project(lat, lng)
    scale = F.pow(F.lit(2.0), zoom) * (1.0 if crs == "Simple" else 256.0)
    return point(scale * (a * p.x + b), scale * (c * p.y + d))


def place_of_pixel(x: Column, y: Column, zoom: Column, crs: str = "EPSG3857") -> Column:
    """The place (x its longitude, y its latitude) of a pixel: the affine step and the projection backwards."""
    name = crs_code(crs).replace(":", "")
    _, (a, b, c, d) = CRS[name]
    scale = F.pow(F.lit(2.0), zoom) * (1.0 if crs == "Simple" else 256.0)
    px, py = (x / scale - b) / a, (y / scale - d) / c
    return {"EPSG3857": mercator_inverse, "EPSG3395": ellipsoidal_mercator_inverse}.get(name, point)(px, py)


def scale_of(zoom: Column) -> Column:
    return 256 * F.pow(F.lit(2.0), zoom)


def zoom_of(scale: Column) -> Column:
    return F.ln(scale / 256) / F.ln(F.lit(2.0))


def _edges(ring: Column) -> Column:
    """Array of structs a, b: each point with the one before it, the first with the last."""
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.get(ring, F.when(i == 0, n - 1).otherwise(i - 1)).alias("b")))


def in_polygon(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over all rings."""
    crosses = lambda e: ((e.a.y > y) != (e.b.y > y)) & (x < (e.b.x - e.a.x) * (y - e.a.y) / (e.b.y - e.a.y) + e.a.x)
    n = F.aggregate(rings, F.lit(0), lambda acc, ring: acc + F.size(F.filter(_edges(ring), crosses)))
    return n % 2 == 1


def closest_on_segment(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    dot = dx * dx + dy * dy
    t = F.when(dot > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / dot))).otherwise(0.0)
    return point(x1 + dx * t, y1 + dy * t)


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    p = closest_on_segment(x, y, x1, y1, x2, y2)
    return planar_distance(x, y, p.x, p.y)


def near_line(points: Column, x: Column, y: Column, tolerance: Column) -> Column:
    """Whether a point lies within tolerance of a line or of a ring given with its first point repeated."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(points) - 1), lambda i: F.struct(F.get(points, i - 1).alias("a"), F.get(points, i).alias("b")))
    return F.when(F.size(points) > 1, F.exists(pairs, lambda e: segment_distance(x, y, e.a.x, e.a.y, e.b.x, e.b.y) <= tolerance)).otherwise(False)


def ring_centroid(ring: Column) -> Column:
    """Centroid by area; the first point if the area is 0."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(acc: Column, e: Column) -> Column:
        f = e.a.y * e.b.x - e.b.y * e.a.x
        return F.struct((acc.s + f * 3).alias("s"), (acc.x + (e.a.x + e.b.x) * f).alias("x"), (acc.y + (e.a.y + e.b.y) * f).alias("y"))

    total = F.aggregate(_edges(ring), zero, add)
    return F.when(total.s == 0, F.get(ring, 0)).otherwise(point(total.x / total.s, total.y / total.s))


def line_midpoint(points: Column) -> Column:
    """The point half-way along a line; its first point if the line has no length."""
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(points) - 1)), lambda i: F.struct(F.get(points, i - 1).alias("a"), F.get(points, i).alias("b")))
    length = lambda e: F.coalesce(planar_distance(e.a.x, e.a.y, e.b.x, e.b.y), F.lit(0.0))
    half = F.aggregate(steps, F.lit(0.0), lambda acc, e: acc + length(e)) / 2
    start = F.struct(F.lit(0.0).alias("gone"), F.lit(None).cast("struct<x:double,y:double>").alias("at"))

    def walk(acc: Column, e: Column) -> Column:
        after = acc.gone + length(e)
        ratio = (after - half) / length(e)
        here = F.when(acc.at.isNull() & (length(e) > 0) & (after >= half), point(e.b.x - ratio * (e.b.x - e.a.x), e.b.y - ratio * (e.b.y - e.a.y))).otherwise(acc.at)
        return F.struct(after.alias("gone"), here.alias("at"))

    return F.coalesce(F.aggregate(steps, start, walk, lambda acc: acc.at), F.get(points, 0))


def same_place(lat1: Column, lng1: Column, lat2: Column, lng2: Column, margin: float = 1e-9) -> Column:
    return F.greatest(F.abs(lat1 - lat2), F.abs(lng1 - lng2)) <= margin


def open_ring(ring: Column) -> Column:
    """A ring without a last point that repeats the first."""
    return F.when((F.size(ring) > 1) & (F.get(ring, 0) == F.get(ring, F.size(ring) - 1)), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)


def closed_ring(ring: Column) -> Column:
    return F.when((F.size(ring) > 1) & (F.get(ring, 0) == F.get(ring, F.size(ring) - 1)), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def clip_segment(x1: Column, y1: Column, x2: Column, y2: Column, b: Column) -> Column:
    """The part of a segment inside a box: struct<a, b> of points, null if none. Its parameters lie between those of the entries
    and exits of the four edges."""
    dx, dy = x2 - x1, y2 - y1
    low, high, inside = F.lit(0.0), F.lit(1.0), F.lit(True)
    for p, q in ((-dx, x1 - b.west), (dx, b.east - x1), (-dy, y1 - b.south), (dy, b.north - y1)):
        low = F.when(p < 0, F.greatest(low, q / p)).otherwise(low)
        high = F.when(p > 0, F.least(high, q / p)).otherwise(high)
        inside = inside & ((p != 0) | (q >= 0))
    return F.when(inside & (low <= high), F.struct(point(x1 + dx * low, y1 + dy * low).alias("a"), point(x1 + dx * high, y1 + dy * high).alias("b")))


def thin_points(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Points nearer than tolerance to the last kept one go, then those within tolerance of the line between kept ones
    (Douglas and Peucker). The first and last point stay."""
    if tolerance <= 0 or len(points) < 3:
        return list(points)
    sq = tolerance * tolerance
    kept = [points[0]]
    for p in points[1:]:
        if (p[0] - kept[-1][0]) ** 2 + (p[1] - kept[-1][1]) ** 2 > sq:
            kept.append(p)
    if kept[-1] != points[-1]:
        kept.append(points[-1])
    stay, open_ends = {0, len(kept) - 1}, [(0, len(kept) - 1)]
    while open_ends:
        first, last = open_ends.pop()
        (ax, ay), (bx, by) = kept[first], kept[last]
        dx, dy = bx - ax, by - ay
        dot = dx * dx + dy * dy
        far, at = sq, None
        for k in range(first + 1, last):
            px, py = kept[k]
            t = min(1.0, max(0.0, ((px - ax) * dx + (py - ay) * dy) / dot)) if dot else 0.0
            d = (px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2
            if d > far:
                far, at = d, k
        if at is not None:
            stay.add(at)
            open_ends += [(first, at), (at, last)]
    return [kept[k] for k in sorted(stay)]


def clip_points(points: list[tuple[float, float]], bounds: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    """A ring's part inside a box (Sutherland and Hodgman): cut at one edge after the other."""
    west, south, east, north = bounds
    for axis, edge, sign in ((0, west, 1), (0, east, -1), (1, south, 1), (1, north, -1)):
        out: list[tuple[float, float]] = []
        for k, b in enumerate(points):
            a = points[k - 1]
            a_in, b_in = sign * (a[axis] - edge) >= 0, sign * (b[axis] - edge) >= 0
            if a_in != b_in:
                t = (edge - a[axis]) / (b[axis] - a[axis])
                other = a[1 - axis] + t * (b[1 - axis] - a[1 - axis])
                out.append((edge, other) if axis == 0 else (other, edge))
            if b_in:
                out.append(b)
        points = out
    return points


def _pairs(ring) -> list[tuple[float, float]]:
    return [(p["x"], p["y"]) for p in ring] if ring is not None else []


def _points(pairs: list[tuple[float, float]]) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in pairs]


@pandas_udf(POINTS)
def simplify_line(points: pd.Series, tolerance: pd.Series) -> pd.Series:
    return pd.Series([_points(thin_points(_pairs(p), t)) for p, t in zip(points, tolerance, strict=True)])


@pandas_udf(POINTS)
def clip_polygon(ring: pd.Series, west: pd.Series, south: pd.Series, east: pd.Series, north: pd.Series) -> pd.Series:
    return pd.Series([_points(clip_points(_pairs(r), b)) for r, *b in zip(ring, west, south, east, north, strict=True)])
