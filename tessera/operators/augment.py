"""The label side of image augmentations: how boxes move when images are combined or warped. Pixels stay with a UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.boxes import Box, area, clip, cols, intersection

from .scans import global_rank

XYXY = ("x1", "y1", "x2", "y2")


def _set(df: DataFrame, b: Box) -> DataFrame:
    return df.withColumns(dict(zip(XYXY, b, strict=True)))


def flip_lr(df: DataFrame, w: Column) -> DataFrame:
    return df.withColumns({"x1": w - F.col("x2"), "x2": w - F.col("x1")})


def flip_ud(df: DataFrame, h: Column) -> DataFrame:
    return df.withColumns({"y1": h - F.col("y2"), "y2": h - F.col("y1")})


def flip_points(points: Column, w: Column | None = None, h: Column | None = None, swap: list[int] | None = None) -> Column:
    """Points (array of struct<x, y, ..>) mirrored at the image's middle, across (``w``) or down (``h``); ``swap`` gives the new order of paired key points."""
    out = points
    if w is not None:
        out = F.transform(out, lambda p: p.withField("x", w - p["x"]))
    if h is not None:
        out = F.transform(out, lambda p: p.withField("y", h - p["y"]))
    return F.transform(F.array(*map(F.lit, swap)), lambda i: F.get(out, i)) if swap else out


def warp_points(points: Column, m: list[list[float]]) -> Column:
    """Points under a 3 x 3 matrix; with a last row other than 0 0 1 the map is projective."""
    def move(p: Column) -> Column:
        row = lambda i: m[i][0] * p["x"] + m[i][1] * p["y"] + m[i][2]
        by = row(2) if list(m[2]) != [0, 0, 1] else F.lit(1.0)
        return p.withField("x", row(0) / by).withField("y", row(1) / by)

    return F.transform(points, move)


def drop_empty(df: DataFrame) -> DataFrame:
    return df.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def mosaic4(boxes: DataFrame, images: DataFrame, size: float) -> DataFrame:
    """(canvas, image_id, gt_id, cls, box): four images around the centre of a ``2 size`` canvas, boxes clipped, empty ones dropped.

    Images go top left, top right, bottom left, bottom right, with their inner corner on the centre.
    """
    place = global_rank(images.select("image_id", "w", "h"), "image_id").withColumns({"canvas": F.floor((F.col("rank") - 1) / 4), "cell": (F.col("rank") - 1) % 4})
    left, top = F.col("cell") % 2 == 0, F.col("cell") < 2
    place = place.select("canvas", "image_id", F.when(left, size - F.col("w")).otherwise(size).alias("dx"), F.when(top, size - F.col("h")).otherwise(size).alias("dy"))
    rows = boxes.join(place, "image_id")
    rows = rows.withColumns({"x1": F.col("x1") + F.col("dx"), "x2": F.col("x2") + F.col("dx"), "y1": F.col("y1") + F.col("dy"), "y2": F.col("y2") + F.col("dy")})
    return drop_empty(_set(rows, clip(cols(*XYXY), F.lit(2 * size), F.lit(2 * size)))).select("canvas", "image_id", "gt_id", "cls", *XYXY)


def mosaic9(boxes: DataFrame, images: DataFrame, size: float) -> DataFrame:
    """(canvas, image_id, gt_id, cls, box): nine images, the first in the middle, the others around it clockwise from the top, cut to a ``2 size`` window half a ``size`` in; empty boxes dropped.

    Each side starts at the first image's edge and goes on where the image before it ends: to the
    right along the top, down on the right, to the left along the bottom, up on the left.
    """
    ranked = global_rank(images.select("image_id", "w", "h"), "image_id").withColumns({"canvas": F.floor((F.col("rank") - 1) / 9), "cell": (F.col("rank") - 1) % 9})
    canvas = Window.partitionBy("canvas").orderBy("cell")  # nine rows
    place = ranked.withColumns({"w0": F.first("w").over(canvas), "h0": F.first("h").over(canvas), "wp": F.lag("w").over(canvas), "hp": F.lag("h").over(canvas)})
    w, h, w0, h0, wp, hp, cell = (F.col(c) for c in ("w", "h", "w0", "h0", "wp", "hp", "cell"))
    right, below = F.when(cell == 2, wp).when(cell.isin(3, 4), w0), F.when(cell == 4, hp).when(cell.isin(5, 6), h0)
    right = right.when(cell == 5, w0 - w).when(cell == 6, w0 - wp - w).when(cell.isin(7, 8), -w).otherwise(0.0)
    below = below.when(cell.isin(1, 2), -h).when(cell == 7, h0 - h).when(cell == 8, h0 - hp - h).otherwise(0.0)
    place = place.select("canvas", "image_id", (size / 2 + right).alias("dx"), (size / 2 + below).alias("dy"))
    rows = boxes.join(place, "image_id")
    moved = (F.col("x1") + F.col("dx"), F.col("y1") + F.col("dy"), F.col("x2") + F.col("dx"), F.col("y2") + F.col("dy"))
    return drop_empty(_set(rows, clip(moved, F.lit(2 * size), F.lit(2 * size)))).select("canvas", "image_id", "gt_id", "cls", *XYXY)


def mixup(a: DataFrame, partners: DataFrame) -> DataFrame:
    """Boxes of every image and of its partner (image_id, partner), unclipped: (image_id, origin, gt_id, cls, box)."""
    own = a.select("image_id", F.col("image_id").alias("origin"), "gt_id", "cls", *XYXY)
    other = a.withColumnRenamed("image_id", "origin").join(partners.withColumnRenamed("partner", "origin"), "origin").select("image_id", "origin", "gt_id", "cls", *XYXY)
    return own.unionByName(other)


def cut_mix(a: DataFrame, partners: DataFrame, cut: Box, least: float = 0.1) -> DataFrame:
    """Donor boxes clipped to the cut area where their share inside is at least ``least``, for images whose own boxes it misses."""
    hit = a.where(intersection(cols(*XYXY), cut) > 0).select("image_id").distinct()
    free = partners.join(hit, "image_id", "left_anti").withColumnRenamed("partner", "origin")
    rows = a.withColumnRenamed("image_id", "origin").join(free, "origin")
    rows = rows.where(intersection(cols(*XYXY), cut) / area(cols(*XYXY)) >= least)
    inside = (F.greatest("x1", cut[0]), F.greatest("y1", cut[1]), F.least("x2", cut[2]), F.least("y2", cut[3]))
    return _set(rows, inside).select("image_id", "origin", "gt_id", "cls", *XYXY)


def copy_paste(a: DataFrame, partners: DataFrame, most: float = 0.3) -> DataFrame:
    """Donor boxes that cover under ``most`` of every box of the image: an anti-join on the pairs that cover more."""
    donors = a.withColumnRenamed("image_id", "origin").join(partners.withColumnRenamed("partner", "origin"), "origin")
    own = a.select(F.col("image_id").alias("i_"), *[F.col(c).alias(f"o{c}") for c in XYXY])
    o = cols(*[f"o{c}" for c in XYXY])
    covers = (F.col("image_id") == F.col("i_")) & (intersection(cols(*XYXY), o) / (area(o) + 1e-7) >= most)
    return donors.join(own, covers, "left_anti").select("image_id", "origin", "gt_id", "cls", *XYXY)


def warp(df: DataFrame, m: tuple[float, float, float, float, float, float], w: float, h: float) -> DataFrame:
    """Boxes under x' = a x + b y + c, y' = d x + e y + f: the corners' enclosing box, clipped; candidates by size, share and shape stay."""
    a, b, c, d, e, f = m
    at = [(a * F.col(x) + b * F.col(y) + c, d * F.col(x) + e * F.col(y) + f) for x in ("x1", "x2") for y in ("y1", "y2")]
    new = clip((F.least(*[p[0] for p in at]), F.least(*[p[1] for p in at]), F.greatest(*[p[0] for p in at]), F.greatest(*[p[1] for p in at])), F.lit(w), F.lit(h))
    nw, nh, scale = new[2] - new[0], new[3] - new[1], abs(a * e - b * d)
    shape = F.greatest(nw / (nh + 1e-16), nh / (nw + 1e-16))
    rows = df.where((nw > 2) & (nh > 2) & (nw * nh / (area(cols(*XYXY)) * scale + 1e-16) > 0.1) & (shape < 100))
    return rows.select("image_id", "gt_id", "cls", *[v.alias(n) for v, n in zip(new, XYXY, strict=True)])


def route_pool(index: DataFrame, n: int, per: int = 4) -> DataFrame:
    """(idx) of a mixed pool of ``n`` originals → segment, image (rank from 0), part: constants only, so no join."""
    parts = [("base", n * per), ("origin", n), ("ratio", n), ("blur", 2 * n), ("compose", -(-n // 4) if n >= 4 else 0), ("weather", n), ("occlusion", n)]
    segment, image, part, start = F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("long"), 0
    for name, length in parts:
        mine, local = (F.col("idx") >= start) & (F.col("idx") < start + length), F.col("idx") - start
        segment = F.when(mine, name).otherwise(segment)
        image = F.when(mine, F.floor(local / per) if name == "base" else local * 4 % n if name == "compose" else local % n).otherwise(image)
        part = F.when(mine, local % per if name == "base" else F.floor(local / n) if name == "blur" else F.lit(0)).otherwise(part)
        start += length
    return index.select("idx", segment.alias("segment"), image.cast("long").alias("image"), part.cast("long").alias("part"))
