"""Label text files: one line an object, ``cls cx cy w h`` or ``cls x1 y1 x2 y2 ...``, shares of the image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def label_path(image_path: Column) -> Column:
    """The last ``/images/`` becomes ``/labels/``, the suffix ``.txt``."""
    return F.regexp_replace(F.regexp_replace(image_path, "^(.*)/images/", "$1/labels/"), "\\.[^./]+$", ".txt")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, value): whole label files below a folder."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def parse(files: DataFrame, classes: int, tolerance: float = 0.01, keypoints: tuple[int, int] | None = None) -> DataFrame:
    """(path, value) → (path, segments, status, rows): status is found, empty or corrupt; rows are arrays of numbers.

    A file is judged whole: rows of another width, coordinates beyond [-tol, 1 + tol], unknown
    classes or text that is no number make it corrupt. With ``keypoints`` (points, 2 or 3 numbers each)
    a row is a box and its points, whose visibility is no coordinate. Rows that repeat collapse, and
    only then the rest comes back sorted.
    """
    lines = F.filter(F.split(F.coalesce("value", F.lit("")), "\r?\n"), lambda x: F.trim(x) != "")
    numbers = F.transform(lines, lambda x: F.transform(F.split(F.trim(x), "\\s+"), lambda v: v.try_cast("double")))
    many = F.lit(False) if keypoints else F.exists("rows", lambda r: F.size(r) > 6)
    rows = files.select("path", numbers.alias("rows")).withColumn("segments", many)
    width = 5 + keypoints[0] * keypoints[1] if keypoints else 5
    wide = lambda r: F.when(F.col("segments"), (F.size(r) >= 7) & (F.size(r) % 2 == 1)).otherwise(F.size(r) == width)
    seen = lambda i: (i >= 5) & ((i - 5) % 3 == 2) if keypoints and keypoints[1] == 3 else F.lit(False)
    inside = lambda r: F.forall(F.transform(r, lambda v, i: (i == 0) | (v.isNotNull() & (seen(i) | ((v <= 1 + tolerance) & (v >= -tolerance))))), lambda ok: F.coalesce(ok, F.lit(False)))
    known = lambda r: F.coalesce((F.get(r, F.lit(0)) >= 0) & (F.get(r, F.lit(0)) < classes), F.lit(False))
    good = F.forall("rows", lambda r: wide(r) & inside(r) & known(r))
    distinct = F.array_distinct("rows")
    tidy = F.when(F.size(distinct) < F.size("rows"), F.array_sort(distinct)).otherwise(F.col("rows"))
    status = F.when(F.size("rows") == 0, "empty").when(good, "found").otherwise("corrupt")
    return rows.select("path", "segments", status.alias("status"), tidy.alias("tidy")).withColumn("rows", F.when(F.col("status") == "found", F.col("tidy")).otherwise(F.array().cast("array<array<double>>"))).drop("tidy")


def poses(parsed: DataFrame, dims: int) -> DataFrame:
    """(path, box_id, cls, cx, cy, w, h, kpts) of found files with key points: kpts is an array of struct<x, y, v>; points of two numbers are visible unless both are 0."""
    row = F.col("row")
    out = parsed.select("path", F.posexplode("rows").alias("box_id", "row"))
    n = F.floor((F.size(row) - 5) / dims).cast("int")
    x, y = (lambda i: F.get(row, 5 + i * dims)), (lambda i: F.get(row, 6 + i * dims))
    v = (lambda i: F.get(row, 7 + i * dims)) if dims == 3 else (lambda i: F.when((x(i) == 0) & (y(i) == 0), 0.0).otherwise(1.0))
    points = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(x(i).alias("x"), y(i).alias("y"), v(i).alias("v")))
    return out.select("path", "box_id", F.get(row, F.lit(0)).cast("int").alias("cls"), *[F.get(row, F.lit(k + 1)).alias(c) for k, c in enumerate(("cx", "cy", "w", "h"))], points.alias("kpts"))


def boxes(parsed: DataFrame) -> DataFrame:
    """(path, box_id, cls, cx, cy, w, h, points) of the found files; a polygon gives its enclosing box."""
    row = F.col("row")
    points = F.transform(F.sequence(F.lit(0), F.floor((F.size(row) - 1) / 2).cast("int") - 1), lambda i: F.struct(F.get(row, 2 * i + 1).alias("x"), F.get(row, 2 * i + 2).alias("y")))
    out = parsed.select("path", "segments", F.posexplode("rows").alias("box_id", "row")).withColumn("points", F.when(F.col("segments"), points))
    edge = lambda f, c: f(F.transform("points", lambda p: p[c]))
    low, high = {c: edge(F.array_min, c) for c in "xy"}, {c: edge(F.array_max, c) for c in "xy"}
    pick = lambda i, poly: F.when(F.col("segments"), poly).otherwise(F.get(row, F.lit(i)))
    return out.select("path", "box_id", F.get(row, F.lit(0)).cast("int").alias("cls"), pick(1, (low["x"] + high["x"]) / 2).alias("cx"), pick(2, (low["y"] + high["y"]) / 2).alias("cy"), pick(3, high["x"] - low["x"]).alias("w"), pick(4, high["y"] - low["y"]).alias("h"), "points")


def counters(images: DataFrame, parsed: DataFrame) -> DataFrame:
    """found, missing, empty and corrupt label files for a table of image paths (``im_file``)."""
    rows = images.select(label_path(F.col("im_file")).alias("path")).join(parsed.select("path", "status"), "path", "left")
    count = lambda s: F.count(F.when(F.col("status") == s, 1))
    return rows.agg((count("found") + count("empty")).alias("found"), F.count(F.when(F.col("status").isNull(), 1)).alias("missing"), count("empty").alias("empty"), count("corrupt").alias("corrupt"))


def lines(rows: DataFrame, key: str, order: list[str], confidence: str | None = None, track: str | None = None) -> DataFrame:
    """(key, text): normalised cls, cx, cy, w, h (and confidence, track id) as label text, one row an image."""
    extra = [F.col(c) for c in (confidence, track) if c]
    line = F.format_string("%d %s", F.col("cls"), F.concat_ws(" ", *[F.format_string("%.6g", c) for c in ("cx", "cy", "w", "h")], *[c.cast("string") for c in extra]))
    packed = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(packed, lambda x: x["line"]), "\n").alias("text"))


def write(texts: DataFrame, key: str, path: str) -> None:
    """Writes label texts below ``path``, a folder an image; Spark's committer keeps retried tasks whole."""
    texts.select(key, "text").write.partitionBy(key).text(path)
