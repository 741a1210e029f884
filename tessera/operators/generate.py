"""Rows made from constants and small rules: grids, crops, decodes, latest files, negative texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sampling import ranked


def point_grid(spark: SparkSession, n: int) -> DataFrame:
    """(i, x, y): the centres of an n by n grid over the unit square, row by row."""
    return spark.range(n * n).select(F.col("id").alias("i"), ((F.col("id") % n + 0.5) / n).alias("x"), ((F.floor(F.col("id") / n) + 0.5) / n).alias("y"))


def crop_layers(images: DataFrame, layers: int, overlap: float = 512 / 1500) -> DataFrame:
    """(image_id, layer, x0, y0, x1, y1): the image, then for each layer 2^layer crops a side, overlapping by a share of the shorter side."""
    whole = images.select("image_id", F.lit(0).alias("layer"), F.lit(0).cast("long").alias("x0"), F.lit(0).cast("long").alias("y0"), F.col("w").cast("long").alias("x1"), F.col("h").cast("long").alias("y1"))
    rows = images.withColumn("layer", F.explode(F.sequence(F.lit(1), F.lit(layers))))
    side = F.pow(F.lit(2.0), F.col("layer"))
    gap = F.floor(overlap * F.least("w", "h") * (2 / side))
    size = lambda full: F.ceil((gap * (side - 1) + full) / side)
    rows = rows.withColumns({"gap": gap, "cw": size(F.col("w")), "ch": size(F.col("h")), "n": side.cast("int")})
    steps = F.sequence(F.lit(0), F.col("n") - 1)
    rows = rows.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    at = lambda k, c: (F.col(c) - F.col("gap")) * F.col(k)
    rows = rows.withColumns({"x0": at("i", "cw"), "y0": at("j", "ch")})
    return whole.unionByName(rows.select("image_id", "layer", "x0", "y0", F.least(F.col("x0") + F.col("cw"), F.col("w").cast("long")).alias("x1"), F.least(F.col("y0") + F.col("ch"), F.col("h").cast("long")).alias("y1")))


def decode_tiles(images: DataFrame, per_image: str) -> DataFrame:
    """(idx, image_id, k): places of all tiles in one index, images in order of id.

    Counts are summed in three levels: in stretches of 4,096 ids, over the 4,096 stretches of a larger
    one, and over those, so that no task sums more than some thousands of rows for 7e10 ids.
    """
    from .scans import running_sums

    rows = images.select("image_id", F.col(per_image).cast("long").alias("n"), F.floor(F.col("image_id") / 4096).alias("part"), F.floor(F.col("image_id") / (1 << 24)).alias("stretch"))
    parts = rows.groupBy("stretch", "part").agg(F.sum("n").alias("held")).withColumn("all", F.lit(0))
    parts = running_sums(parts, ["all"], "stretch", [F.col("part")], {"upto": "held"}).select("part", (F.col("upto") - F.col("held")).alias("base"))
    inside = Window.partitionBy("part").orderBy("image_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("stop", F.sum("n").over(inside)).join(parts, "part").where("n > 0")
    return rows.select("image_id", (F.col("base") + F.col("stop") - F.col("n")).alias("start"), F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k", "one")).select((F.col("start") + F.col("k")).alias("idx"), "image_id", "k")


def latest(files: DataFrame, group: str, name: str, time: str) -> DataFrame:
    """The last file of each group; of equal times the first name."""
    return files.groupBy(group).agg(F.min_by(name, F.struct(-F.unix_micros(F.col(time).cast("timestamp")), F.col(name))).alias(name))


def velocity(points: DataFrame, back: int = 3) -> DataFrame:
    """Adds dx, dy: the unit direction from the point ``back`` frames ago, or from the oldest one there is after it."""
    w = Window.partitionBy("track_id").orderBy("frame")
    oldest = F.first(F.struct("x", "y")).over(w.rowsBetween(-back, 0))
    rows = points.withColumn("old", oldest)
    vx, vy = F.col("x") - F.col("old.x"), F.col("y") - F.col("old.y")
    n = F.sqrt(vx * vx + vy * vy) + 1e-6
    return rows.withColumns({"dx": vx / n, "dy": vy / n}).drop("old")


def negative_texts(texts: DataFrame, least: int, k: int, seed: str) -> DataFrame:
    """``k`` of the texts that occur ``least`` times or more, by hash."""
    often = texts.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return ranked(often, "name", seed).where(F.col("rank") <= k).drop("rank")


def text_prompts(labels: DataFrame, names: dict[int, str], most: int, negatives: int, seed: str) -> DataFrame:
    """(image_id, classes, texts): what an image is asked for: its own classes, ``most`` at most, then ``negatives`` others as far as there is room, both by hash; ``texts`` is filled up to ``most`` with empty ones.

    ``classes`` gives the new number of each old class: its place. The names are a constant list, so an
    image's classes are all that is gathered.
    """
    own = labels.groupBy("image_id").agg(F.collect_set("cls").alias("own"))
    order = lambda c: F.md5(F.concat_ws(":", F.col("image_id").cast("string"), c.cast("string"), F.lit(seed)))
    by_hash = lambda array: F.transform(F.array_sort(F.transform(array, lambda c: F.struct(order(c).alias("h"), c.alias("c")))), lambda x: x["c"])
    every = F.array(*[F.lit(k) for k in sorted(names)])
    chosen = F.slice(by_hash("own"), 1, most)
    rows = own.withColumn("chosen", chosen).withColumn("rest", by_hash(F.array_except(every, F.col("own"))))
    room = F.least(F.lit(negatives), F.lit(most) - F.size("chosen"))
    rows = rows.withColumn("classes", F.concat("chosen", F.slice("rest", F.lit(1), F.greatest(F.lit(0), room))))
    text = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    texts = F.concat(F.transform("classes", lambda c: F.element_at(text, c)), F.array_repeat(F.lit(""), F.lit(most) - F.size("classes")))
    return rows.select("image_id", "classes", texts.alias("texts"))


def ratio_pad(boxes: DataFrame, images: DataFrame, ratio: float) -> DataFrame:
    """Normalised (cx, cy, w, h) after an image is padded on both sides to width / height = ``ratio``."""
    size = images.select("image_id", F.greatest(F.col("w"), F.col("h") * ratio).alias("pw"), F.greatest(F.col("h"), F.col("w") / ratio).alias("ph"), F.col("w").alias("iw"), F.col("h").alias("ih"))
    rows = boxes.join(size, "image_id").withColumns({"px": (F.col("pw") - F.col("iw")) / 2, "py": (F.col("ph") - F.col("ih")) / 2})
    unit = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    return rows.select("image_id", "gt_id", "cls", unit(((F.col("x1") + F.col("x2")) / 2 + F.col("px")) / F.col("pw")).alias("cx"), unit(((F.col("y1") + F.col("y2")) / 2 + F.col("py")) / F.col("ph")).alias("cy"), unit((F.col("x2") - F.col("x1")) / F.col("pw")).alias("w"), unit((F.col("y2") - F.col("y1")) / F.col("ph")).alias("h"))


def allowed_new(new: DataFrame, tracks: DataFrame, score: float, most_iou: float) -> DataFrame:
    """Detections above ``score`` that no track of their image overlaps by more than ``most_iou``: an anti-join; suppress among them afterwards."""
    from tessera.functions.boxes import cols, iou, overlaps

    t = tracks.select(F.col("image_id").alias("i_"), *[F.col(c).alias(f"t{c}") for c in ("x1", "y1", "x2", "y2")])
    a, b = cols("x1", "y1", "x2", "y2"), cols("tx1", "ty1", "tx2", "ty2")
    return new.where(F.col("conf") > score).join(t, (F.col("image_id") == F.col("i_")) & overlaps(a, b) & (iou(a, b) > most_iou), "left_anti")
