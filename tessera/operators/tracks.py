"""Analytics over track points (track_id, frame, x, y): windows over a track's frames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.shapes import inside, passes_through, segments_cross


def by_track() -> Window:
    return Window.partitionBy("track_id").orderBy("frame")


def with_previous(points: DataFrame) -> DataFrame:
    """Adds px, py: the track's place one frame before (null on its first)."""
    return points.withColumns({"px": F.lag("x").over(by_track()), "py": F.lag("y").over(by_track())})


def history(points: DataFrame, size: int = 30) -> DataFrame:
    """Adds ``history``: the track's last ``size`` points, this one included."""
    return points.withColumn("history", F.collect_list(F.struct("x", "y")).over(by_track().rowsBetween(-(size - 1), 0)))


def line_crossings(points: DataFrame, line: list[tuple[float, float]]) -> DataFrame:
    """(track_id, frame, direction): the first time that each track crosses the line; a track counts once."""
    (ax, ay), (bx, by) = line
    steps = with_previous(points).where("px is not null")
    steps = steps.where(segments_cross(F.col("px"), F.col("py"), F.col("x"), F.col("y"), line))
    inward = F.col("x") > F.col("px") if abs(ax - bx) < abs(ay - by) else F.col("y") > F.col("py")
    first = F.row_number().over(by_track())
    return steps.withColumn("n", first).where("n = 1").select("track_id", "frame", F.when(inward, "in").otherwise("out").alias("direction"))


def region_entries(points: DataFrame, polygon: list[tuple[float, float]], look_back: int = 5) -> DataFrame:
    """(track_id, frame, direction): the first time that each track is in the polygon, or crosses it between two frames, after its first frame.

    A step counts as crossing if it starts outside and passes through the inside. Direction goes by
    the greater part of the track's own motion (right or down is in), from the first of its last
    ``look_back`` points that lies outside the polygon (the oldest of them if none does).
    """
    rows = with_previous(points).withColumn("in_", inside(F.col("x"), F.col("y"), polygon))
    trail = F.collect_list(F.struct("x", "y", "in_")).over(by_track().rowsBetween(-(look_back - 1), 0))
    rows = rows.withColumns({"trail": trail, "was_": F.lag("in_").over(by_track())}).where("px is not null")
    crosses = ~F.col("was_") & passes_through(F.col("px"), F.col("py"), F.col("x"), F.col("y"), polygon)
    rows = rows.where(F.col("in_") | crosses).withColumn("n", F.row_number().over(by_track())).where("n = 1")
    base = F.coalesce(F.get(F.filter("trail", lambda p: ~p["in_"]), F.lit(0)), F.get("trail", F.lit(0)))
    dx, dy = F.col("x") - base["x"], F.col("y") - base["y"]
    inward = F.when(F.abs(dx) > F.abs(dy), dx > 0).otherwise(dy > 0)
    return rows.select("track_id", "frame", F.when(inward, "in").otherwise("out").alias("direction"))


def region_counts(points: DataFrame, regions: dict[str, list[tuple[float, float]]], edge: bool = False, whole_pixels: bool = False, need_previous: bool = False) -> DataFrame:
    """(frame, region, n): points in each region on each frame. Regions are a few constants, so no join is needed."""
    rows = with_previous(points).where("px is not null") if need_previous else points
    x, y = (F.col("x").cast("long").cast("double"), F.col("y").cast("long").cast("double")) if whole_pixels else (F.col("x"), F.col("y"))
    held = F.array_compact(F.array(*[F.when(inside(x, y, p, edge), F.lit(name)) for name, p in regions.items()]))
    return rows.select("frame", F.explode(held).alias("region")).groupBy("frame", "region").agg(F.count(F.lit(1)).alias("n"))


def slot_occupancy(points: DataFrame, slots: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """(frame, occupied, free): parking slots with a centre inside or on the edge, whole pixels."""
    taken = region_counts(points, slots, edge=True, whole_pixels=True).groupBy("frame").agg(F.count(F.lit(1)).alias("occupied"))
    return points.select("frame").distinct().join(taken, "frame", "left").select("frame", F.coalesce("occupied", F.lit(0)).alias("occupied"), (len(slots) - F.coalesce("occupied", F.lit(0))).alias("free"))


def speeds(points: DataFrame, history_size: int = 5, metres_per_pixel: float = 0.05, fps: float = 30.0, most: int = 120) -> DataFrame:
    """(track_id, speed): whole km/h from a track's first point to its ``history_size``-th, capped; shorter tracks have none."""
    n = F.row_number().over(by_track())
    ends = points.withColumn("n", n).where(F.col("n").isin(1, history_size)).groupBy("track_id").agg(*[F.max(F.when(F.col("n") == k, F.col(c))).alias(f"{c}{k}") for k in (1, history_size) for c in ("x", "y", "frame")])
    seconds = (F.col(f"frame{history_size}") - F.col("frame1")) / fps
    distance = F.hypot(F.col(f"x{history_size}") - F.col("x1"), F.col(f"y{history_size}") - F.col("y1")) * metres_per_pixel
    return ends.where(seconds > 0).select("track_id", F.least(F.lit(most), F.floor(distance / seconds * 3.6).cast("int")).alias("speed"))


def stage_repetitions(rows: DataFrame, angle: Column, up: float, down: float) -> DataFrame:
    """Adds ``reps``: how often the stage went from down to up so far; between the limits the last stage holds."""
    stage = F.when(angle > up, "up").when(angle < down, "down")
    rows = rows.withColumn("stage", F.last(stage, ignorenulls=True).over(by_track()))
    turned = (F.col("stage") == "up") & (F.lag("stage").over(by_track()) == "down")
    return rows.withColumn("turned", turned.cast("int")).withColumn("reps", F.sum(F.coalesce("turned", F.lit(0))).over(by_track())).drop("turned")


def ema(points: DataFrame, column: str, alpha: float) -> DataFrame:
    """(track_id, frame, smooth): s = alpha s + (1 - alpha) x along the track, starting with its first value.

    The fold is sequential; tracks lie sorted in their partitions and go through it an Arrow batch at a
    time, with one number a track carried over, so no track is held as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track, last = None, 0.0
        for batch in batches:
            ids, frames, values = (batch.column(i).to_pylist() for i in range(3))
            out = []
            for t, v in zip(ids, values, strict=True):
                last = v if t != track else alpha * last + (1 - alpha) * v
                track = t
                out.append(last)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["track_id", "frame", "smooth"])

    rows = points.select("track_id", "frame", F.col(column).cast("double").alias("v")).repartition("track_id").sortWithinPartitions("track_id", "frame")
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    return rows.mapInArrow(run, f"track_id {kinds['track_id']}, frame {kinds['frame']}, smooth double")


def alarms(points: DataFrame, records: int) -> DataFrame:
    """(frame, n): the first frame with at least ``records`` detections."""
    counts = points.groupBy("frame").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= records)
    return counts.agg(F.min(F.struct("frame", "n")).alias("a")).where("a is not null").select("a.*")


def class_counts(points: DataFrame, every: int = 1) -> DataFrame:
    """(bin, cls, n, share): detections of each class in bins of ``every`` frames."""
    rows = points.groupBy(F.floor(F.col("frame") / every).alias("bin"), "cls").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("bin")) * 100, 6))


def heatmap(boxes: DataFrame, cell: int = 1) -> DataFrame:
    """(px, py, heat): 2 for every box in whose inscribed circle the pixel (of ``cell`` by ``cell``) lies."""
    low = lambda c: F.floor(F.col(c) / cell)
    rows = boxes.select(((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), (F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / 2).alias("r"), F.explode(F.sequence(low("x1"), low("x2"))).alias("px"), low("y1").alias("a"), low("y2").alias("b"))
    rows = rows.withColumn("py", F.explode(F.sequence("a", "b")))
    dx, dy = F.col("px") * cell - F.col("cx"), F.col("py") * cell - F.col("cy")
    return rows.where(dx * dx + dy * dy <= F.col("r") * F.col("r")).groupBy("px", "py").agg((F.count(F.lit(1)) * 2).alias("heat"))


def anti_by_id(a: DataFrame, b: DataFrame, key: str = "track_id") -> DataFrame:
    return a.join(b.select(key).distinct(), key, "left_anti")


def joint_by_id(a: DataFrame, b: DataFrame, key: str = "track_id") -> DataFrame:
    """``a`` and what ``b`` has beyond it."""
    return a.unionByName(anti_by_id(b, a, key))


def distances(points: DataFrame, pixels_per_metre: float) -> DataFrame:
    """(track_id, frame, distance) of each track to its frame's first one (lowest id), in metres."""
    first = points.groupBy("frame").agg(F.min_by(F.struct("track_id", "x", "y"), "track_id").alias("f"))
    rows = points.join(first, "frame").where(F.col("track_id") != F.col("f.track_id"))
    return rows.select("track_id", "frame", (F.hypot(F.col("x") - F.col("f.x"), F.col("y") - F.col("f.y")) / pixels_per_metre).alias("distance"))
