"""Tiles and windows over images: 1→N expansion, box clipping with ownership, mapping back, compositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.boxes import Box, area, cols

from .scans import global_rank

#: Order of a 2×2 grid: top left, bottom left, top right, bottom right.
ORDER = ((0, 0), (1, 0), (0, 1), (1, 1))


def grid_2x2(images: DataFrame, overlap: float = 0.2, bias_x: Column | None = None, bias_y: Column | None = None, order: tuple = ORDER, keep: tuple[str, ...] = ()) -> DataFrame:
    """Four overlapping tiles an image: (image_id, w, h, k, x0, y0, x1, y1, seam_x, seam_y), with the columns ``keep``. A bias moves the seams."""
    side = lambda size: F.least(size, F.greatest(F.lit(1.0), F.floor(size * (1 + overlap) / 2).cast("double")))
    sw, sh = side(F.col("w")), side(F.col("h"))
    shift = lambda bias, size, s: F.least(size - s, F.greatest(-(size - s), F.coalesce(bias, F.lit(0.0)))) if bias is not None else F.lit(0.0)
    bx, by = shift(bias_x, F.col("w"), sw), shift(bias_y, F.col("h"), sh)
    left, right = (F.lit(0.0), F.least(F.col("w"), sw + bx)), (F.greatest(F.lit(0.0), F.col("w") - sw + bx), F.col("w"))
    top, bottom = (F.lit(0.0), F.least(F.col("h"), sh + by)), (F.greatest(F.lit(0.0), F.col("h") - sh + by), F.col("h"))
    tiles = [F.struct(F.lit(k).alias("k"), (right if c else left)[0].alias("x0"), (bottom if r else top)[0].alias("y0"), (right if c else left)[1].alias("x1"), (bottom if r else top)[1].alias("y1")) for k, (r, c) in enumerate(order)]
    seams = images.withColumns({"seam_x": (left[1] + right[0]) / 2, "seam_y": (top[1] + bottom[0]) / 2, "tile": F.explode(F.array(*tiles))})
    return seams.select("image_id", "w", "h", "tile.*", "seam_x", "seam_y", *keep)


def windows(images: DataFrame, crop: int, gap: int, least_rate: float = 0.6) -> DataFrame:
    """Sliding windows of ``crop`` with step ``crop - gap``, the last one moved to the edge; windows of low image share go unless all are."""
    step = crop - gap

    def starts(size: Column) -> Column:
        n = F.when(size <= crop, 1).otherwise(F.ceil((size - crop) / step + 1)).cast("int")
        plain = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i * step).cast("double"))
        return F.transform(plain, lambda x: F.when((n > 1) & (x + crop > size), size - crop).otherwise(x))

    places = F.array_distinct(F.flatten(F.transform(starts(F.col("w")), lambda x: F.transform(starts(F.col("h")), lambda y: F.struct(x.alias("x0"), y.alias("y0"))))))
    inner = lambda p: (F.least(p["x0"] + crop, F.col("w")) - p["x0"]) * (F.least(p["y0"] + crop, F.col("h")) - p["y0"]) / float(crop * crop)
    rows = images.withColumn("places", F.transform(places, lambda p: F.struct(p["x0"].alias("x0"), p["y0"].alias("y0"), inner(p).alias("rate"))))
    rows = rows.withColumn("best", F.array_max(F.transform("places", lambda p: p["rate"])))
    chosen = F.filter("places", lambda p: (p["rate"] > least_rate) | ((F.col("best") <= least_rate) & (p["rate"] == F.col("best"))))
    rows = rows.withColumn("p", F.explode(chosen))
    return rows.select(*images.columns, "p.x0", "p.y0", (F.col("p.x0") + crop).alias("x1"), (F.col("p.y0") + crop).alias("y1"), "p.rate")


def multi_scale(images: DataFrame, rates: tuple[float, ...], crop: int, gap: int, least_rate: float = 0.6) -> DataFrame:
    """Sliding windows at several rates: at rate r the windows are ``crop / r`` wide, so that they have ``crop`` pixels of the scaled image. Adds ``scale``."""
    out = None
    for r in rates:
        rows = windows(images, int(crop / r), int(gap / r), least_rate).withColumn("scale", F.lit(float(r)))
        out = rows if out is None else out.unionByName(rows)
    return out


def uncrop_points(points: Column, x0: Column, y0: Column) -> Column:
    """Points of a crop back on its image."""
    return F.transform(points, lambda p: p.withField("x", p["x"] + x0).withField("y", p["y"] + y0))


def _clip(b: Box) -> Box:
    return F.greatest(b[0], F.col("x0")), F.greatest(b[1], F.col("y0")), F.least(b[2], F.col("tx1")), F.least(b[3], F.col("ty1"))


def _on_tiles(boxes: DataFrame, tiles: DataFrame) -> DataFrame:
    """Every box with the tiles of its image that it overlaps, clipped (cx1..cy2), with inter and its own area."""
    t = tiles.withColumnsRenamed({"x1": "tx1", "y1": "ty1"})
    b = cols("x1", "y1", "x2", "y2")
    rows = boxes.join(t, "image_id").where((F.col("x1") < F.col("tx1")) & (F.col("x2") > F.col("x0")) & (F.col("y1") < F.col("ty1")) & (F.col("y2") > F.col("y0")))
    clipped = _clip(b)
    return rows.withColumns({"cx1": clipped[0], "cy1": clipped[1], "cx2": clipped[2], "cy2": clipped[3]}).withColumns({"inter": area(cols("cx1", "cy1", "cx2", "cy2")), "own": area(b)})


def tile_boxes(boxes: DataFrame, tiles: DataFrame, min_area: float = 0.01, retain: float = 0.3, centre: bool = False, whole: bool = False) -> DataFrame:
    """Boxes in tile coordinates (image_id, k, gt_id, cls, x1, y1, x2, y2) under the slicing rules.

    A box goes only if its part is small both for the tile and for the box. ``centre``: it stays in
    the tile that owns its centre (cut at the seams' middle), or where its share reaches ``retain``.
    ``whole``: only boxes that the tile holds entirely.
    """
    rows = _on_tiles(boxes, tiles)
    tile = (F.col("tx1") - F.col("x0")) * (F.col("ty1") - F.col("y0"))
    keep = ~((F.col("inter") < min_area * tile) & (F.col("inter") < retain * F.col("own")))
    if centre:
        right, below = (F.col("x1") + F.col("x2")) / 2 >= F.col("seam_x"), (F.col("y1") + F.col("y2")) / 2 >= F.col("seam_y")
        owner = F.when(right, F.when(below, 3).otherwise(2)).otherwise(F.when(below, 1).otherwise(0))
        mine = F.col("k") == owner
        keep = mine if retain >= 1 else mine | (F.col("inter") >= retain * F.col("own"))
    if whole:
        keep = F.col("inter") >= F.col("own") - 1e-9
    return _in_tile(rows.where(keep))


def _in_tile(rows: DataFrame) -> DataFrame:
    return rows.select("image_id", "k", "gt_id", "cls", (F.col("cx1") - F.col("x0")).alias("x1"), (F.col("cy1") - F.col("y0")).alias("y1"), (F.col("cx2") - F.col("x0")).alias("x2"), (F.col("cy2") - F.col("y0")).alias("y2"))


def validation_boxes(boxes: DataFrame, tiles: DataFrame) -> DataFrame:
    """Boxes of sliced validation: every part wider and higher than one pixel."""
    return _in_tile(_on_tiles(boxes, tiles).where("cx2 - cx1 > 1 and cy2 - cy1 > 1"))


def canvas(tw: Column, th: Column, size: int) -> tuple[Column, Column, Column]:
    """Gain and left, top padding of a tile that is centred on a square canvas of ``size``, made smaller only; halves round to even."""
    r = F.least(F.lit(1.0), size / F.greatest(tw, th))
    pad = lambda side: F.bround((size - F.bround(side * r)) / 2.0 - 0.1)
    return r, pad(tw), pad(th)


def to_canvas(boxes: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """Boxes in tile coordinates on the canvas that a model sees of the tile."""
    t = tiles.select("image_id", "k", (F.col("x1") - F.col("x0")).alias("tw"), (F.col("y1") - F.col("y0")).alias("th"))
    r, left, top = canvas(F.col("tw"), F.col("th"), size)
    return boxes.join(t, ["image_id", "k"]).withColumns({"x1": F.col("x1") * r + left, "x2": F.col("x2") * r + left, "y1": F.col("y1") * r + top, "y2": F.col("y2") * r + top}).drop("tw", "th")


def to_original(boxes: DataFrame, tiles: DataFrame, size: int | None = None) -> DataFrame:
    """Boxes in tile coordinates, or on tiles' canvases of ``size``, back on their images."""
    t = tiles.select("image_id", "k", "x0", "y0", (F.col("x1") - F.col("x0")).alias("tw"), (F.col("y1") - F.col("y0")).alias("th"))
    r, left, top = canvas(F.col("tw"), F.col("th"), size) if size else (F.lit(1.0), F.lit(0.0), F.lit(0.0))
    back = lambda c, pad, at: (F.col(c) - pad) / r + F.col(at)
    return boxes.join(t, ["image_id", "k"]).withColumns({"x1": back("x1", left, "x0"), "x2": back("x2", left, "x0"), "y1": back("y1", top, "y0"), "y2": back("y2", top, "y0")}).drop("x0", "y0", "tw", "th")


def through_canvas(boxes: DataFrame, images: DataFrame, size: int) -> DataFrame:
    """``boxes`` with the tile ``k`` of each part wider and higher than one pixel, and the part as it comes back from the tile's canvas of ``size``.

    What :func:`validation_boxes`, :func:`to_canvas` and :func:`to_original` give over the four tiles of
    :func:`grid_2x2`, with one join: an image's size comes to its boxes, and never as a broadcast, as
    the estimate of a table of images is far below what it takes.
    """
    held = boxes.join(images.select("image_id", "w", "h").hint("merge"), "image_id").withColumn("box", F.struct(*[c for c in boxes.columns if c != "image_id"]))
    b = tuple(F.col(f"box.{c}") for c in ("x1", "y1", "x2", "y2"))
    rows = grid_2x2(held.select("image_id", "w", "h", "box"), keep=("box",)).withColumnsRenamed({"x1": "tx1", "y1": "ty1"})
    rows = rows.where((b[0] < F.col("tx1")) & (b[2] > F.col("x0")) & (b[1] < F.col("ty1")) & (b[3] > F.col("y0")))
    rows = rows.withColumns(dict(zip(("cx1", "cy1", "cx2", "cy2"), _clip(b), strict=True))).where("cx2 - cx1 > 1 and cy2 - cy1 > 1")
    r, left, top = canvas(F.col("tx1") - F.col("x0"), F.col("ty1") - F.col("y0"), size)
    back = lambda c, at, pad: (((F.col(c) - F.col(at)) * r + pad) - pad) / r + F.col(at)
    return rows.select("image_id", "k", *[F.col(f"box.{c}") for c in boxes.columns if c not in ("image_id", "x1", "y1", "x2", "y2")], back("cx1", "x0", left).alias("x1"), back("cy1", "y0", top).alias("y1"), back("cx2", "x0", left).alias("x2"), back("cy2", "y0", top).alias("y2"))


def _near(places: Column, centres: Column, size: Column, reach: Column) -> Column:
    """How many centres lie nearer than ``reach`` to each place (a share of ``size``)."""
    return F.transform(places, lambda p: F.size(F.filter(centres, lambda c: F.abs(c - p * size) < reach)))


def seam_bias(images: DataFrame, boxes: DataFrame, candidates: int = 32, margin: float = 0.25, jitter: float = 0.0, seed: str = "0") -> DataFrame:
    """(image_id, bias_x, bias_y): where to put an image's seams, as shares of its sides away from the middle.

    Of evenly spaced places between the margins, the first that has the fewest box centres nearer than
    half the median box size (at least 5% of the side). (0, 0) without boxes. ``jitter`` moves each by a
    uniform amount that the image and the seed (an epoch) determine. An image's boxes are read once.
    """
    sides = {"x": ("w", F.col("x1"), F.col("x2")), "y": ("h", F.col("y1"), F.col("y2"))}
    held = boxes.groupBy("image_id").agg(*[x for k, (_, a, b) in sides.items() for x in (F.collect_list((a + b) / 2.0).alias(f"c{k}"), F.percentile(b - a, F.lit(0.5)).alias(f"m{k}"))])
    places = F.array(*[F.lit(margin + i * ((1 - 2 * margin) / (candidates - 1))) for i in range(candidates)])
    rows, out = images.select("image_id", "w", "h").join(held, "image_id", "left"), {}
    for k, (side, _, _) in sides.items():
        rows = rows.withColumn(f"n{k}", _near(places, F.col(f"c{k}"), F.col(side), F.greatest(F.col(f"m{k}"), F.col(side) * 0.05) / 2))
        best = F.element_at(places, F.array_position(f"n{k}", F.array_min(f"n{k}")).cast("int"))
        if jitter:
            u = F.conv(F.substring(F.md5(F.concat(F.col("image_id").cast("string"), F.lit(f":{k}:{seed}"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
            best = F.least(F.lit(1 - margin), F.greatest(F.lit(margin), best + (2 * u - 1) * jitter))
        out[f"bias_{k}"] = F.when(F.col(f"m{k}").isNull(), 0.0).otherwise(best - 0.5)
    return rows.select("image_id", *[v.alias(n) for n, v in out.items()])


def compose_2x2(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """Groups of four images on one canvas: normalised xywh at half size, shifted by the cell. (canvas, image_id, gt_id, cls, cx, cy, w, h)."""
    place = global_rank(images.select("image_id", F.col("w").alias("iw"), F.col("h").alias("ih")), "image_id").withColumn("rank", F.col("rank") - 1)
    rows = boxes.join(place, "image_id").withColumns({"canvas": F.floor(F.col("rank") / 4), "col": F.col("rank") % 2, "row": F.floor(F.col("rank") % 4 / 2)})
    return rows.select("canvas", "image_id", "gt_id", "cls", (((F.col("x1") + F.col("x2")) / 2 / F.col("iw") + F.col("col")) / 2).alias("cx"), (((F.col("y1") + F.col("y2")) / 2 / F.col("ih") + F.col("row")) / 2).alias("cy"), ((F.col("x2") - F.col("x1")) / F.col("iw") / 2).alias("w"), ((F.col("y2") - F.col("y1")) / F.col("ih") / 2).alias("h"))


def pool_segments(n: Column, per: int = 4) -> list[tuple[str, Column]]:
    """Names and lengths of a mixed pool's segments for ``n`` originals."""
    return [("base", n * per), ("origin", n), ("ratio", n), ("blur", n * 2), ("compose", F.when(n >= 4, F.ceil(n / 4)).otherwise(0)), ("weather", n), ("occlusion", n)]


def pool_layout(sizes: DataFrame, per: int = 4) -> DataFrame:
    """(n, segment, start, stop) of each pool of ``n`` originals."""
    parts = pool_segments(F.col("n"), per)
    rows, base = [], F.lit(0)
    for name, length in parts:
        rows.append(F.struct(F.lit(name).alias("segment"), base.cast("long").alias("start"), (base + length).cast("long").alias("stop")))
        base = base + length
    return sizes.select("n", F.explode(F.array(*rows)).alias("s")).select("n", "s.*")
