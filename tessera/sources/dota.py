"""Oriented-box text files of large images: parsing, tile names, and merging of tile predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.boxes import prob_iou

RBOX = ("cx", "cy", "w", "h", "theta")


def parse(lines: DataFrame, classes: dict[str, int]) -> DataFrame:
    """(path, value) lines ``x1 y1 .. x4 y4 class [difficult]`` → (path, cls, points, difficult); other lines (headers) go."""
    parts = F.split(F.trim("value"), "\\s+")
    rows = lines.select("path", parts.alias("p")).where("size(p) >= 9")
    number = lambda i: F.get("p", F.lit(i)).try_cast("double")
    points = F.array(*[F.struct(number(2 * i).alias("x"), number(2 * i + 1).alias("y")) for i in range(4)])
    names = F.create_map(*[x for k, v in classes.items() for x in (F.lit(k), F.lit(v))])
    out = rows.select("path", F.element_at(names, F.get("p", F.lit(8))).alias("cls"), points.alias("points"), F.coalesce(F.get("p", F.lit(9)).try_cast("int"), F.lit(0)).alias("difficult"))
    return out.where(F.forall("points", lambda q: q["x"].isNotNull() & q["y"].isNotNull()) & F.col("cls").isNotNull())


def tile_name(stem: Column, rate: float, x0: Column, y0: Column) -> Column:
    return F.concat(stem, F.lit(f"__{rate}__"), x0.cast("long").cast("string"), F.lit("___"), y0.cast("long").cast("string"))


def offsets(name: Column) -> tuple[Column, Column, Column]:
    """(stem, x, y) of a tile's name."""
    return F.regexp_extract(name, "^(.*?)__", 1), F.regexp_extract(name, "(\\d+)___(\\d+)$", 1).try_cast("double"), F.regexp_extract(name, "(\\d+)___(\\d+)$", 2).try_cast("double")


def merge(pred: DataFrame, thr: float = 0.3) -> DataFrame:
    """Tile predictions (tile, det_id, cls, conf, cx, cy, w, h, theta) on their images, by class without those that a more confident one covers: an anti-join."""
    stem, x, y = offsets(F.col("tile"))
    rows = pred.select(stem.alias("image"), "tile", "det_id", "cls", "conf", (F.col("cx") + x).alias("cx"), (F.col("cy") + y).alias("cy"), "w", "h", "theta")
    q = rows.select(*[F.col(c).alias(f"q_{c}") for c in rows.columns])
    better = (F.col("q_conf") > F.col("conf")) | ((F.col("q_conf") == F.col("conf")) & (F.struct("q_tile", "q_det_id") < F.struct("tile", "det_id")))
    reach = (F.hypot("w", "h") + F.hypot("q_w", "q_h")) / 2
    near = (F.abs(F.col("cx") - F.col("q_cx")) < reach) & (F.abs(F.col("cy") - F.col("q_cy")) < reach)
    score = prob_iou(tuple(F.col(c) for c in RBOX), tuple(F.col(f"q_{c}") for c in RBOX))
    on = (F.col("image") == F.col("q_image")) & (F.col("cls") == F.col("q_cls")) & better & near & (score >= thr)
    return rows.join(q, on, "left_anti")


def task_lines(rows: DataFrame) -> DataFrame:
    """(cls, value): one line a box, ``image score x1 y1 .. x4 y4``; written with ``partitionBy('cls')`` it is a file a class."""
    from tessera.functions.boxes import corners

    at = [v for p in corners(*[F.col(c) for c in RBOX]) for v in p]
    return rows.select("cls", F.concat_ws(" ", F.col("image"), F.round("conf", 3).cast("string"), *[F.round(v, 3).cast("string") for v in at]).alias("value"))
