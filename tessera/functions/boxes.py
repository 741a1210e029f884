"""Boxes as columns. A box is four double columns; its format (xyxy, xywh by centre, ltwh) belongs to the projection."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def cols(*names: str) -> Box:
    return tuple(F.col(n) for n in names)  # type: ignore[return-value]


def xyxy_to_xywh(b: Box) -> Box:
    x1, y1, x2, y2 = b
    return (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1


def xywh_to_xyxy(b: Box) -> Box:
    x, y, w, h = b
    return x - w / 2, y - h / 2, x + w / 2, y + h / 2


def xyxy_to_ltwh(b: Box) -> Box:
    x1, y1, x2, y2 = b
    return x1, y1, x2 - x1, y2 - y1


def ltwh_to_xyxy(b: Box) -> Box:
    x, y, w, h = b
    return x, y, x + w, y + h


def xywh_to_ltwh(b: Box) -> Box:
    x, y, w, h = b
    return x - w / 2, y - h / 2, w, h


def ltwh_to_xywh(b: Box) -> Box:
    x, y, w, h = b
    return x + w / 2, y + h / 2, w, h


def normalise(b: Box, w: Column, h: Column) -> Box:
    """Pixels to shares of the image, for any format."""
    return b[0] / w, b[1] / h, b[2] / w, b[3] / h


def denormalise(b: Box, w: Column, h: Column, pad_x: float = 0.0, pad_y: float = 0.0) -> Box:
    """Normalised xywh to padded pixel xyxy."""
    x, y, bw, bh = b
    return w * (x - bw / 2) + pad_x, h * (y - bh / 2) + pad_y, w * (x + bw / 2) + pad_x, h * (y + bh / 2) + pad_y


def clip(b: Box, w: Column, h: Column) -> Box:
    low = lambda v, top: F.greatest(F.lit(0.0), F.least(v, top))
    return low(b[0], w), low(b[1], h), low(b[2], w), low(b[3], h)


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def letterbox(from_w: Column, from_h: Column, to_w: Column, to_h: Column) -> tuple[Column, Column, Column]:
    """Gain and left, top padding with which an image of ``from`` size was fitted into ``to``; halves round to even."""
    gain = F.least(to_h / from_h, to_w / from_w)
    pad = lambda to, size: F.bround((to - F.bround(size * gain)) / 2 - 0.1)
    return gain, pad(to_w, from_w), pad(to_h, from_h)


def scale_back(b: Box, from_w: Column, from_h: Column, to_w: Column, to_h: Column) -> Box:
    """Boxes on a letterboxed ``to`` canvas back to the ``from`` image, clipped."""
    gain, px, py = letterbox(from_w, from_h, to_w, to_h)
    return clip(((b[0] - px) / gain, (b[1] - py) / gain, (b[2] - px) / gain, (b[3] - py) / gain), from_w, from_h)


def scale_points_back(points: Column, from_w: Column, from_h: Column, to_w: Column, to_h: Column) -> Column:
    """Points (array of struct<x, y, ..>) on a letterboxed ``to`` canvas back on the ``from`` image, clipped; other fields stay."""
    gain, px, py = letterbox(from_w, from_h, to_w, to_h)
    at = lambda v, pad, top: F.greatest(F.lit(0.0), F.least((v - pad) / gain, top))
    return F.transform(points, lambda p: p.withField("x", at(p["x"], px, from_w)).withField("y", at(p["y"], py, from_h)))


def snap(b: Box, w: Column, h: Column, near: float = 20.0) -> Box:
    """Edges within ``near`` pixels of the image's border move onto it."""
    return F.when(b[0] < near, 0.0).otherwise(b[0]), F.when(b[1] < near, 0.0).otherwise(b[1]), F.when(b[2] > w - near, w).otherwise(b[2]), F.when(b[3] > h - near, h).otherwise(b[3])


def corners(cx: Column, cy: Column, w: Column, h: Column, theta: Column) -> list[tuple[Column, Column]]:
    """The corners of a rotated box, in order around it."""
    c, s = F.cos(theta), F.sin(theta)
    ux, uy, vx, vy = w / 2 * c, w / 2 * s, -h / 2 * s, h / 2 * c
    return [(cx + ux + vx, cy + uy + vy), (cx + ux - vx, cy + uy - vy), (cx - ux - vx, cy - uy - vy), (cx - ux + vx, cy - uy + vy)]


def enclosing(cx: Column, cy: Column, w: Column, h: Column, theta: Column) -> Box:
    """The upright box around a rotated one."""
    xs, ys = zip(*corners(cx, cy, w, h, theta), strict=True)
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def union_area(b: Box, rects: Column) -> Column:
    """Area of a box that the rectangles (an array of struct<x1, y1, x2, y2>) cover together, each place once.

    The box is cut into stripes at the rectangles' edges; in a stripe the covered length is the union
    of the intervals of those that span it, added up in order of their start.
    """
    inside = lambda v, low, high: F.greatest(low, F.least(v, high))
    cut = F.transform(rects, lambda r: F.struct(inside(r["x1"], b[0], b[2]).alias("x1"), inside(r["y1"], b[1], b[3]).alias("y1"), inside(r["x2"], b[0], b[2]).alias("x2"), inside(r["y2"], b[1], b[3]).alias("y2")))
    cut = F.filter(cut, lambda r: (r["x2"] > r["x1"]) & (r["y2"] > r["y1"]))
    edges = F.array_sort(F.array_distinct(F.concat(F.transform(cut, lambda r: r["x1"]), F.transform(cut, lambda r: r["x2"]))))
    stripes = F.zip_with(F.slice(edges, 1, F.greatest(F.lit(0), F.size(edges) - 1)), F.slice(edges, 2, F.greatest(F.lit(0), F.size(edges) - 1)), lambda p, q: F.struct(p.alias("a"), q.alias("b")))

    def covered(stripe: Column) -> Column:
        spans = F.array_sort(F.transform(F.filter(cut, lambda r: (r["x1"] <= stripe["a"]) & (r["x2"] >= stripe["b"])), lambda r: F.struct(r["y1"].alias("lo"), r["y2"].alias("hi"))))
        start = F.struct(F.lit(float("-inf")).alias("reach"), F.lit(0.0).alias("sum"))
        step = lambda s, i: F.struct(F.greatest(s["reach"], i["hi"]).alias("reach"), (s["sum"] + F.greatest(F.lit(0.0), i["hi"] - F.greatest(s["reach"], i["lo"]))).alias("sum"))
        return F.aggregate(spans, start, step, lambda s: s["sum"]) * (stripe["b"] - stripe["a"])

    return F.aggregate(F.transform(stripes, covered), F.lit(0.0), lambda s, v: s + v)


def regularise(w: Column, h: Column, theta: Column) -> tuple[Column, Column, Column]:
    """Rotation in [0, pi/2), with sides swapped where a quarter turn was taken off."""
    half = math.pi / 2
    swap = F.pmod(theta, F.lit(math.pi)) >= half
    return F.when(swap, h).otherwise(w), F.when(swap, w).otherwise(h), F.pmod(theta, F.lit(half))


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Box, b: Box, eps: float = 1e-7) -> Column:
    """Intersection over union; ``eps`` is added to the union."""
    inter = intersection(a, b)
    return inter / (area(a) + area(b) - inter + eps)


def ioa(a: Box, b: Box, eps: float = 1e-7) -> Column:
    """Intersection over the second box's area."""
    return intersection(a, b) / (area(b) + eps)


def overlaps(a: Box, b: Box) -> Column:
    """The range predicate under which the intersection is positive."""
    return (a[0] < b[2]) & (a[2] > b[0]) & (a[1] < b[3]) & (a[3] > b[1])


def extended_iou(a: Box, b: Box, eps: float = 1e-7) -> dict[str, Column]:
    """GIoU, DIoU and CIoU."""
    wa, ha, wb, hb = a[2] - a[0], a[3] - a[1] + eps, b[2] - b[0], b[3] - b[1] + eps
    inter = intersection(a, b)
    union = wa * ha + wb * hb - inter + eps
    value = inter / union
    cw, ch = F.greatest(a[2], b[2]) - F.least(a[0], b[0]), F.greatest(a[3], b[3]) - F.least(a[1], b[1])
    hull = cw * ch + eps
    span = cw * cw + ch * ch + eps
    dx, dy = b[0] + b[2] - a[0] - a[2], b[1] + b[3] - a[1] - a[3]
    apart = (dx * dx + dy * dy) / 4
    turn = F.atan(wb / hb) - F.atan(wa / ha)
    v = F.lit(4 / math.pi**2) * turn * turn
    return {"giou": value - (hull - union) / hull, "diou": value - apart / span, "ciou": value - (apart / span + v * (v / (v - value + (1 + eps))))}


def gaussian(w: Column, h: Column, theta: Column) -> tuple[Column, Column, Column]:
    """Covariance (a, b, c) of a rotated box taken as a Gaussian."""
    a, b, c, s = w * w / 12, h * h / 12, F.cos(theta), F.sin(theta)
    return a * c * c + b * s * s, a * s * s + b * c * c, (a - b) * c * s


def prob_iou(p: tuple[Column, ...], q: tuple[Column, ...], eps: float = 1e-7) -> Column:
    """1 - Hellinger distance of two rotated boxes (cx, cy, w, h, theta)."""
    (a1, b1, c1), (a2, b2, c2) = gaussian(*p[2:]), gaussian(*q[2:])
    dx, dy, a, b, c = q[0] - p[0], p[1] - q[1], a1 + a2, b1 + b2, c1 + c2
    det = a * b - c * c
    t1 = (a * dy * dy + b * dx * dx) / (det + eps) * 0.25
    t2 = c * dx * dy / (det + eps) * 0.5
    own = lambda x, y, z: F.greatest(F.lit(0.0), x * y - z * z)
    t3 = F.log(det / (4 * F.sqrt(own(a1, b1, c1) * own(a2, b2, c2)) + eps) + eps) * 0.5
    bd = F.least(F.lit(100.0), F.greatest(F.lit(eps), t1 + t2 + t3))
    return 1 - F.sqrt(1 - F.exp(-bd) + eps)
