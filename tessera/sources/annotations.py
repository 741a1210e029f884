"""Annotation JSON: COCO-style documents, grounding captions, newline-delimited records, prediction files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COCO = "images array<struct<id:bigint,width:double,height:double,file_name:string,caption:string>>, annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>,iscrowd:int,segmentation:array<array<double>>,keypoints:array<double>,tokens_positive:array<array<int>>>>, categories array<struct<id:int,name:string>>"
RECORD = "type string, task string, file string, url string, split string, class_names map<string,string>, annotations map<string,array<array<double>>>"
PREDICTION = "image_id long, file_name string, category_id int, bbox array<double>, score double"


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COCO).json(path, multiLine=True)


def coco_boxes(document: DataFrame) -> DataFrame:
    """(image_id, file_name, cls, cx, cy, w, h): crowds and boxes without area go, equal (cls, box) of an image collapse."""
    images = document.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), F.col("i.file_name").alias("file_name"), F.col("i.width").alias("iw"), F.col("i.height").alias("ih"))
    a = document.select(F.explode("annotations").alias("a")).where("coalesce(a.iscrowd, 0) = 0")
    a = a.select("a.image_id", (F.col("a.category_id") - 1).alias("cls"), *[F.get("a.bbox", F.lit(i)).alias(c) for i, c in enumerate("xywh")])
    at = a.join(images, "image_id")
    at = at.select("image_id", "file_name", "cls", ((F.col("x") + F.col("w") / 2) / F.col("iw")).alias("cx"), ((F.col("y") + F.col("h") / 2) / F.col("ih")).alias("cy"), (F.col("w") / F.col("iw")).alias("w"), (F.col("h") / F.col("ih")).alias("h"))
    return at.where("w > 0 and h > 0").dropDuplicates(["image_id", "cls", "cx", "cy", "w", "h"])


def coco_objects(document: DataFrame, from_91: bool = False) -> DataFrame:
    """(image_id, file_name, cls, cx, cy, w, h, segment, keypoints): boxes with their outline and key points as shares of the image.

    Several polygons become one ring; without any, the outline is the box. ``from_91`` maps the
    categories of that numbering to 0 .. 79. Crowds and boxes without area go, equal (cls, box) collapse.
    """
    from tessera.functions.kernels import bridge
    from tessera.operators.results import from_91 as mapped

    images = document.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), F.col("i.file_name").alias("file_name"), F.col("i.width").alias("iw"), F.col("i.height").alias("ih"))
    a = document.select(F.explode("annotations").alias("a")).where("coalesce(a.iscrowd, 0) = 0 and a.bbox[2] > 0 and a.bbox[3] > 0")
    rows = a.select("a.image_id", (mapped(F.col("a.category_id")) if from_91 else F.col("a.category_id") - 1).alias("cls"), *[F.get("a.bbox", F.lit(i)).alias(c) for i, c in enumerate("xywh")], "a.segmentation", "a.keypoints").join(images, "image_id")

    @F.pandas_udf("array<double>")
    def joined(parts: pd.Series) -> pd.Series:
        return pd.Series([bridge([np.array(p, float).reshape(-1, 2) for p in x]).reshape(-1).tolist() for x in parts])

    x, y, w, h = (F.col(c) for c in "xywh")
    box = F.array(x, y, x + w, y, x + w, y + h, x, y + h)
    parts = F.coalesce(F.size("segmentation"), F.lit(0))
    rows = rows.withColumn("box", box)
    one = rows.where(parts <= 1).withColumn("ring", F.when(parts == 1, F.get("segmentation", F.lit(0))).otherwise(F.col("box")))
    rows = one.unionByName(rows.where(parts > 1).withColumn("ring", joined("segmentation")))
    share = lambda ring: F.transform(ring, lambda v, i: v / F.when(i % 2 == 0, F.col("iw")).otherwise(F.col("ih")))
    points = F.transform("keypoints", lambda v, i: F.when(i % 3 == 0, v / F.col("iw")).when(i % 3 == 1, v / F.col("ih")).otherwise(v))
    out = rows.select("image_id", "file_name", "cls", ((x + w / 2) / F.col("iw")).alias("cx"), ((y + h / 2) / F.col("ih")).alias("cy"), (w / F.col("iw")).alias("w"), (h / F.col("ih")).alias("h"), share("ring").alias("segment"), points.alias("keypoints"))
    return out.dropDuplicates(["image_id", "cls", "cx", "cy", "w", "h"])


def coco_document(images: DataFrame, boxes: DataFrame, names: dict[int, str]) -> DataFrame:
    """(kind, value): a ground-truth document's parts as JSON lines: images, annotations with left, top, width, height, and categories from 1."""
    spark = images.sparkSession
    im = images.select(F.lit("image").alias("kind"), F.to_json(F.struct(F.col("image_id").alias("id"), F.col("im_file").alias("file_name"), F.col("w").alias("width"), F.col("h").alias("height"))).alias("value"))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    an = annotation_ids(boxes).select(F.lit("annotation").alias("kind"), F.to_json(F.struct(F.col("annotation_id").alias("id"), "image_id", (F.col("cls") + 1).alias("category_id"), F.array("x1", "y1", w, h).alias("bbox"), (w * h).alias("area"), F.lit(0).alias("iscrowd"))).alias("value"))
    cat = spark.createDataFrame([(k + 1, v) for k, v in names.items()], "id int, name string").select(F.lit("category").alias("kind"), F.to_json(F.struct("*")).alias("value"))
    return im.unionByName(an).unionByName(cat)


def coco_names(document: DataFrame) -> DataFrame:
    return document.select(F.explode("categories").alias("c")).select((F.col("c.id") - 1).alias("cls"), "c.name")


def grounding_boxes(document: DataFrame) -> DataFrame:
    """(image_id, cls, text, x, y, w, h): an annotation's text is its caption's spans; classes count an image's texts in order of appearance."""
    from pyspark.sql import Window

    images = document.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), F.col("i.caption").alias("caption"))
    a = document.select(F.posexplode("annotations").alias("n", "a")).where("coalesce(a.iscrowd, 0) = 0").select("n", "a.image_id", "a.bbox", "a.tokens_positive").join(images, "image_id")
    spans = F.transform("tokens_positive", lambda t: F.substr(F.col("caption"), F.get(t, F.lit(0)) + 1, F.get(t, F.lit(1)) - F.get(t, F.lit(0))))
    rows = a.withColumn("text", F.lower(F.trim(F.array_join(spans, " ")))).where("text <> '' and bbox[2] > 0 and bbox[3] > 0")
    first = F.min("n").over(Window.partitionBy("image_id", "text"))
    rows = rows.withColumn("first", first).withColumn("cls", F.dense_rank().over(Window.partitionBy("image_id").orderBy("first")) - 1)
    return rows.select("image_id", "cls", "text", *[F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate("xywh")])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a newline-delimited dataset, with ``type``: one dataset line, then image lines."""
    return spark.read.schema(RECORD).json(path)


def record_boxes(records: DataFrame, kind: str = "boxes") -> DataFrame:
    """(file, split, box_id, cls, values) of one annotation kind."""
    rows = records.where("type = 'image'").select("file", "split", F.posexplode(F.element_at("annotations", kind)).alias("box_id", "row"))
    return rows.select("file", "split", "box_id", F.get("row", F.lit(0)).cast("int").alias("cls"), F.slice("row", 2, F.size("row") - 1).alias("values"))


def auto_validation(records: DataFrame, share: int = 10, seed: str = "val") -> DataFrame:
    """The image records; where none is marked for validation, ``max(1, n // share)`` of the ``n`` training images are, chosen by hash.

    Images of other splits stay as they are. Raises ValueError where there is no training image, or
    only one to split.
    """
    from tessera.operators.sampling import ranked

    images = records.where("type = 'image'")
    n = images.agg(F.count(F.when(F.col("split") == "train", 1)).alias("train"), F.count(F.when(F.col("split") == "val", 1)).alias("val")).first()
    if not n["train"]:
        raise ValueError("no training images")
    if n["val"]:
        return images
    if n["train"] < 2:
        raise ValueError("one training image cannot be split")
    train = F.coalesce(F.col("split") == "train", F.lit(False))
    chosen = ranked(images.where(train), "file", seed).withColumn("split", F.when(F.col("rank") <= max(1, n["train"] // share), "val").otherwise(F.col("split"))).drop("rank")
    return chosen.unionByName(images.where(~train))


def keypoint_shape(rows: DataFrame) -> tuple[int, int]:
    """(points, dims) that the first 50 pose rows (``values`` after the box) share; 3 dims if each third is 0, 1 or 2."""
    seen = [r[0] for r in rows.select(F.slice("values", 5, F.greatest(F.lit(0), F.size("values") - 4))).limit(50).collect()]
    sizes = {len(v) for v in seen}
    if len(sizes) != 1 or not (n := sizes.pop()):
        raise ValueError("pose rows of different or no length")
    if n % 3 == 0 and all(v in (0.0, 1.0, 2.0) for row in seen for v in row[2::3]):
        return n // 3, 3
    if n % 2 == 0 and n % 3:
        return n // 2, 2
    raise ValueError(f"{n} numbers are no keypoints")


def predictions_json(pred: DataFrame, file_name: str = "file_name") -> DataFrame:
    """(value): one prediction a line; left top width height to 3 places, score to 5; a numeric stem is the image id."""
    stem = F.regexp_extract(file_name, "([^/]+?)(\\.[^./]*)?$", 1)
    rows = pred.select(F.when(stem.rlike("^[0-9]+$"), stem.try_cast("long")).alias("image_id"), F.col(file_name).alias("file_name"), F.col("cls").alias("category_id"), F.array(*[F.round(c, 3) for c in (F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))]).alias("bbox"), F.round("conf", 5).alias("score"))
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def shapes_json(rows: DataFrame, key: str, names: dict[int, str]) -> DataFrame:
    """(key, value): one JSON document an image, each box a rectangle of four points."""
    label = F.element_at(F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))]), F.col("cls"))
    point = lambda x, y: F.array(F.col(x), F.col(y))
    shape = F.struct(label.alias("label"), F.array(point("x1", "y1"), point("x2", "y1"), point("x2", "y2"), point("x1", "y2")).alias("points"), F.lit("rectangle").alias("shape_type"))
    packed = F.array_sort(F.collect_list(F.struct("gt_id", shape.alias("shape"))))
    return rows.groupBy(key).agg(F.to_json(F.struct(F.transform(packed, lambda s: s["shape"]).alias("shapes"), F.first(key).cast("string").alias("imagePath"))).alias("value"))


def annotation_ids(rows: DataFrame) -> DataFrame:
    """Adds ``annotation_id``: the image id above 32 bits, the box's place below, plus one."""
    return rows.withColumn("annotation_id", F.shiftleft(F.col("image_id").cast("long"), 32).bitwiseOR(F.col("gt_id").cast("long")) + 1)
