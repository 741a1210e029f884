"""What a prediction table looks like from outside: accessors, summaries, exports, log lines, class maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.boxes import cols, normalise, xyxy_to_xywh

#: Ids of the 91-class numbering that no class of the 80 has.
UNUSED_IDS = (12, 26, 29, 30, 45, 66, 68, 69, 71, 83, 91)


def name_of(cls: Column, names: dict[int, str]) -> Column:
    return F.element_at(F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))]), cls)


def accessors(pred: DataFrame, w: Column, h: Column) -> DataFrame:
    """Adds xyxy, xywh, xyxyn and xywhn: arrays of four numbers, the last two as shares of the image."""
    b = cols("x1", "y1", "x2", "y2")
    forms = {"xyxy": b, "xywh": xyxy_to_xywh(b), "xyxyn": normalise(b, w, h), "xywhn": normalise(xyxy_to_xywh(b), w, h)}
    return pred.withColumns({k: F.array(*v) for k, v in forms.items()})


def points_of(points: Column, w: Column, h: Column, decimals: int, visible: bool = False) -> Column:
    """Points (an array of struct<x, y[, v]>) as a struct of arrays x, y[, visible]."""
    pick = lambda c, by: F.transform(points, lambda p: F.round(p[c] / by, decimals))
    parts = [pick("x", w).alias("x"), pick("y", h).alias("y")]
    return F.struct(*parts, *([pick("v", F.lit(1.0)).alias("visible")] if visible else []))


def summary(pred: DataFrame, names: dict[int, str], w: Column | None = None, h: Column | None = None, decimals: int = 5, corners: str | None = None, track: str | None = None, segments: str | None = None, keypoints: str | None = None, visible: bool = False) -> DataFrame:
    """(image_id, det_id, name, class, confidence, box[, track_id][, segments][, keypoints]), rounded; as shares of the image if ``w`` and ``h`` are given.

    ``corners``: a column of four points, for rotated boxes, whose box then has x1 .. y4.
    """
    w, h = F.lit(1.0) if w is None else w, F.lit(1.0) if h is None else h
    if corners:
        at = [(F.get(corners, F.lit(i))["x"], F.get(corners, F.lit(i))["y"]) for i in range(4)]
    else:
        at = [(F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2"))]
    box = F.struct(*[F.round(v / by, decimals).alias(f"{c}{i + 1}") for i, p in enumerate(at) for v, by, c in ((p[0], w, "x"), (p[1], h, "y"))])
    more = [F.col(track).cast("long").alias("track_id")] if track else []
    more += [points_of(F.col(segments), w, h, decimals).alias("segments")] if segments else []
    more += [points_of(F.col(keypoints), w, h, decimals, visible).alias("keypoints")] if keypoints else []
    return pred.select("image_id", "det_id", name_of(F.col("cls"), names).alias("name"), F.col("cls").alias("class"), F.round("conf", decimals).alias("confidence"), box.alias("box"), *more)


def top_classes(scores: DataFrame, names: dict[int, str], k: int = 5, decimals: int = 5) -> DataFrame:
    """(image_id, rank, name, class, confidence) of the ``k`` greatest entries of ``probs``; ties go to the lower class."""
    ranked = F.slice(F.array_sort(F.transform("probs", lambda p, i: F.struct((-p).alias("p"), i.alias("c")))), 1, k)
    rows = scores.select("image_id", F.posexplode(ranked).alias("rank", "r"))
    return rows.select("image_id", (F.col("rank") + 1).alias("rank"), name_of(F.col("r.c"), names).alias("name"), F.col("r.c").alias("class"), F.round(-F.col("r.p"), decimals).alias("confidence"))


def pixel_ratio(pixels: DataFrame, names: dict[int, str], decimals: int = 5) -> DataFrame:
    """(image_id, name, class, pixel_ratio) from (image_id, cls, n) pixel counts; classes without a name (ignored ones) count for the total only."""
    from pyspark.sql import Window

    total = F.sum("n").over(Window.partitionBy("image_id"))
    rows = pixels.groupBy("image_id", "cls").agg(F.sum("n").alias("n")).withColumn("ratio", F.round(F.col("n") / total, decimals))
    return rows.where(F.col("cls").isin(*names)).select("image_id", name_of(F.col("cls"), names).alias("name"), F.col("cls").alias("class"), F.col("ratio").alias("pixel_ratio"))


def log_lines(images: DataFrame, pred: DataFrame, names: dict[int, str]) -> DataFrame:
    """(image_id, line): ``2 persons, 1 car, `` in order of class; images without detections say so."""
    counts = pred.groupBy("image_id", "cls").agg(F.count(F.lit(1)).alias("n"))
    part = F.concat(F.col("n").cast("string"), F.lit(" "), name_of(F.col("cls"), names), F.when(F.col("n") > 1, "s").otherwise(""), F.lit(", "))
    lines = counts.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("cls", part.alias("part")))).alias("parts"))
    lines = lines.select("image_id", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("line"))
    return images.select("image_id").join(lines, "image_id", "left").select("image_id", F.coalesce("line", F.lit("(no detections), ")).alias("line"))


def json_lines(rows: DataFrame) -> DataFrame:
    """(value): a JSON object a row; write it with ``write.text`` or read it with ``from_json``."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def csv_lines(rows: DataFrame) -> DataFrame:
    """(value): a CSV line a row; nested columns become JSON text first."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f"`{f.name}`") for f in rows.schema.fields]
    return rows.select(F.to_csv(F.struct(*flat)).alias("value"))


def from_91(category: Column) -> Column:
    """Class 0 .. 79 of an id in the 91-class numbering (from 1); null for ids that none has."""
    below = sum((F.when(category > F.lit(u), 1).otherwise(0) for u in UNUSED_IDS), F.lit(0))
    return F.when(category.between(1, 91) & ~category.isin(*UNUSED_IDS), (category - 1 - below).cast("int"))


def to_91(cls: Column) -> Column:
    """Id in the 91-class numbering of a class 0 .. 79."""
    ids = [i for i in range(1, 92) if i not in UNUSED_IDS]
    return F.get(F.array(*map(F.lit, ids)), cls)


def remap(value: Column, mapping: dict[int, int], other: int = 255) -> Column:
    """Pixel or class values by a table of at most 256 entries; the rest becomes ``other``."""
    table = [mapping.get(i, other) for i in range(256)]
    return F.coalesce(F.get(F.array(*map(F.lit, table)), value.cast("int")), F.lit(other))


def stability(values: DataFrame, threshold: float, offset: float) -> DataFrame:
    """(mask, stability): pixels above ``threshold + offset`` over those above ``threshold - offset``, of rows (mask, v)."""
    above = lambda t: F.sum(F.when(F.col("v") > t, 1).otherwise(0))
    return values.groupBy("mask").agg((above(threshold + offset) / above(threshold - offset)).alias("stability"))


def set_decoder(pred: DataFrame, size: float, conf: float, most: int) -> DataFrame:
    """Output of a set decoder, (image_id, det_id, cx, cy, w, h, conf, cls) with shares of a square of ``size``, in its own order → pixel xyxy above ``conf``, the first ``most`` an image; no suppression."""
    from pyspark.sql import Window

    rows = pred.where(F.col("conf") > conf).withColumn("rn", F.row_number().over(Window.partitionBy("image_id").orderBy("det_id"))).where(F.col("rn") <= most)
    box = {"x1": F.col("cx") - F.col("w") / 2, "y1": F.col("cy") - F.col("h") / 2, "x2": F.col("cx") + F.col("w") / 2, "y2": F.col("cy") + F.col("h") / 2}
    return rows.select("image_id", "det_id", "cls", "conf", *[(v * size).alias(k) for k, v in box.items()])


def best_class(raw: DataFrame, conf: float, classes: list[int] | None = None) -> DataFrame:
    """Boxes with an array of class ``scores`` → one row each with its best class (the lower one of a tie) above ``conf``; suppression takes it from there."""
    best = F.array_max("scores")
    rows = raw.withColumns({"conf": best, "cls": (F.array_position("scores", best) - 1).cast("int")}).where(F.col("conf") > conf)
    return (rows.where(F.col("cls").isin(classes)) if classes is not None else rows).drop("scores")


def every_class(raw: DataFrame, conf: float) -> DataFrame:
    """The same with a row for every class above ``conf``."""
    rows = raw.select("*", F.posexplode("scores").alias("cls", "conf")).where(F.col("conf") > conf)
    return rows.drop("scores")


def whole_image_masks(crops: DataFrame, images: DataFrame, conf: float, least_stability: float, thr: float, crop_thr: float, near: float = 20.0) -> DataFrame:
    """Mask candidates of an image's crops, (image_id, crop, det_id, conf, stability, cx0, cy0, cx1, cy1, x1 .. y2 in the crop) → those that stay, on the image.

    Score and stability filters, then boxes at a crop's inner edge go, greedy suppression by score in
    each crop, and by smallness of the crop over the image. ``det_id`` is unique in an image.
    """
    from .suppress import greedy_nms

    rows = crops.where((F.col("conf") > conf) & (F.col("stability") > least_stability)).join(images.select("image_id", "w", "h"), "image_id")
    edge = F.lit(False)
    for c, at, low in (("x1", "cx0", F.lit(0.0)), ("y1", "cy0", F.lit(0.0)), ("x2", "cx1", F.col("w")), ("y2", "cy1", F.col("h"))):
        where = F.col(c) + F.col("cx0" if c[0] == "x" else "cy0")
        edge = edge | ((F.abs(where - F.col(at)) <= near) & ~(F.abs(where - low) <= near))
    rows = rows.where(~edge).drop("w", "h")
    inside = greedy_nms(rows, thr, keys=("image_id", "crop"), by_class=False)
    moved = {c: F.col(c) + F.col("cx0" if c[0] == "x" else "cy0") for c in ("x1", "y1", "x2", "y2")}
    area = (F.col("cx1") - F.col("cx0")) * (F.col("cy1") - F.col("cy0"))
    on = inside.withColumns(moved | {"score": F.col("conf"), "conf": 1 / area})
    return greedy_nms(on, crop_thr, by_class=False).withColumn("conf", F.col("score")).drop("score")


def select_by_points(masks: DataFrame, points: DataFrame) -> DataFrame:
    """(image_id, det_id) chosen by points (image_id, place, x, y, label): a mask takes the label of the last point in it; without one it is
    chosen only if all of the image's points are negative. Masks are boxes here: x1 <= x < x2, y1 <= y < y2.
    """
    p = points.select(F.col("image_id").alias("i_"), "place", "x", "y", "label")
    inside = (F.col("image_id") == F.col("i_")) & (F.col("x") >= F.col("x1")) & (F.col("x") < F.col("x2")) & (F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y2"))
    last = masks.join(p, inside).groupBy("image_id", "det_id").agg(F.max_by("label", "place").alias("label"))
    kinds = points.groupBy("image_id").agg((F.max("label") == 0).alias("negative"))
    rows = masks.select("image_id", "det_id").join(kinds, "image_id").join(last, ["image_id", "det_id"], "left")
    return rows.where(F.coalesce(F.col("label") == 1, "negative")).select("image_id", "det_id")
