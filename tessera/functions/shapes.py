"""Points, polygons, angles and strings as columns. A polygon is an array of struct<x, y>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def polygon(points: list[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def crossings(x: Column, y: Column, points: list[tuple[float, float]]) -> Column:
    """Number of the polygon's edges that a ray to the right crosses."""
    total = F.lit(0)
    for (ax, ay), (bx, by) in zip(points, [*points[1:], points[0]], strict=True):
        if ay != by:
            spans = (F.lit(float(ay)) > y) != (F.lit(float(by)) > y)
            total = total + F.when(spans & (x < (bx - ax) * (y - ay) / (by - ay) + ax), 1).otherwise(0)
    return total


def on_edge(x: Column, y: Column, points: list[tuple[float, float]]) -> Column:
    hit = F.lit(False)
    for (ax, ay), (bx, by) in zip(points, [*points[1:], points[0]], strict=True):
        flat = ((x - ax) * (by - ay) - (y - ay) * (bx - ax)) == 0
        hit = hit | (flat & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by)))
    return hit


def inside(x: Column, y: Column, points: list[tuple[float, float]], edge: bool = False) -> Column:
    """Point in polygon; ``edge`` tells whether the boundary counts."""
    odd = crossings(x, y, points) % 2 == 1
    return (odd | on_edge(x, y, points)) if edge else (odd & ~on_edge(x, y, points))


def _side(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_cross(ax: Column, ay: Column, bx: Column, by: Column, line: list[tuple[float, float]]) -> Column:
    """Whether the closed segments a–b and ``line`` meet."""
    (px, py), (qx, qy) = line
    p = [F.lit(float(v)) for v in (px, py, qx, qy)]
    d1, d2 = _side(*p, ax, ay), _side(*p, bx, by)
    d3, d4 = _side(ax, ay, bx, by, p[0], p[1]), _side(ax, ay, bx, by, p[2], p[3])
    between = lambda a, b, c: (c >= F.least(a, b)) & (c <= F.greatest(a, b))
    touch = ((d1 == 0) & between(p[0], p[2], ax) & between(p[1], p[3], ay)) | ((d2 == 0) & between(p[0], p[2], bx) & between(p[1], p[3], by)) | ((d3 == 0) & between(ax, bx, p[0]) & between(ay, by, p[1])) | ((d4 == 0) & between(ax, bx, p[2]) & between(ay, by, p[3]))
    return ((d1 * d2 < 0) & (d3 * d4 < 0)) | touch


def passes_through(ax: Column, ay: Column, bx: Column, by: Column, points: list[tuple[float, float]]) -> Column:
    """Whether a segment runs through the polygon's inside and also outside of it.

    The segment is cut where it meets an edge; the middle of each part tells where that part lies.
    """
    dx, dy, cuts = bx - ax, by - ay, [F.lit(0.0), F.lit(1.0)]
    for (px, py), (qx, qy) in zip(points, [*points[1:], points[0]], strict=True):
        ex, ey = qx - px, qy - py
        turn = dx * ey - dy * ex
        t, u = ((px - ax) * ey - (py - ay) * ex) / turn, ((px - ax) * dy - (py - ay) * dx) / turn
        cuts.append(F.when((turn != 0) & t.between(0, 1) & u.between(0, 1), t))
    at = F.array_sort(F.array_distinct(F.array_compact(F.array(*cuts))))
    middles = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda s, t: (s + t) / 2)
    within = F.exists(middles, lambda t: inside(ax + t * dx, ay + t * dy, points))
    without = F.exists(middles, lambda t: ~inside(ax + t * dx, ay + t * dy, points, edge=True))
    return within & without


def bounds(points: Column) -> tuple[Column, Column, Column, Column]:
    """The enclosing box of a point array."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def ring_length(points: Column) -> Column:
    """Perimeter of a closed polygon."""
    after = F.concat(F.slice(points, 2, F.size(points) - 1), F.slice(points, 1, 1))
    return F.aggregate(F.zip_with(points, after, lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])), F.lit(0.0), lambda s, d: s + d)


def ring_area(points: Column) -> Column:
    after = F.concat(F.slice(points, 2, F.size(points) - 1), F.slice(points, 1, 1))
    return F.abs(F.aggregate(F.zip_with(points, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, d: s + d)) / 2


def joint_angle(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Angle at b in degrees, at most 180."""
    a = F.degrees(F.abs(F.atan2(cy - by, cx - bx) - F.atan2(ay - by, ax - bx)))
    return F.when(a > 180, 360 - a).otherwise(a)


def centroid_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of two centres, each floored to whole pixels."""
    return F.hypot((F.floor(ax) - F.floor(bx)).cast("double"), (F.floor(ay) - F.floor(by)).cast("double"))


def make_divisible(x: Column, by: int) -> Column:
    return (F.ceil(x / by) * by).cast("long")


def clean_str(s: Column) -> Column:
    """Characters that are awkward in file names become underscores."""
    return F.regexp_replace(s, "[|@#!¡·$€%&()=?¿^*;:,¨`><+]", "_")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return dot(a, b) / (norm(a) * norm(b))
