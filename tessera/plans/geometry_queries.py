"""Formats, points, segments, label files and sized metrics over the canonical tables, with DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.functions import boxes as bx
from tessera.functions import kernels, shapes
from tessera.operators import augment as au
from tessera.operators import evaluation as ev
from tessera.operators import sampling, spatial, tiling
from tessera.sources import annotations, datasets, labels
from tessera.storage import settled
from tessera.streaming import tracker

from . import evaluation_queries as eq
from .augment_queries import _ring, tracked
from .canonical import ctes, read, table
from .result_queries import NAMES

T = lambda s, d, *names: [table(s, d, n) for n in names]
WH = lambda: (F.lit(1200.0), F.lit(900.0))
_B = ("x1", "y1", "x2", "y2")
_POINTS = lambda: _ring(*_B)


def box_ltwh(s, d):
    """Every conversion to and from left, top, width, height."""
    b = bx.cols(*_B)
    ltwh = bx.xywh_to_ltwh(bx.xyxy_to_xywh(b))
    back, centre = bx.ltwh_to_xyxy(ltwh), bx.ltwh_to_xywh(ltwh)
    again = bx.xywh_to_xyxy(bx.xyxy_to_xywh(b))
    return table(s, d, "gt").select("image_id", "gt_id", ltwh[0].alias("left"), ltwh[3].alias("height"), back[2].alias("right"), back[3].alias("bottom"), centre[0].alias("cx"), centre[1].alias("cy"), again[0].alias("x1"), again[3].alias("y2"))


def box_enclosing(s, d):
    b = bx.enclosing(*bx.xyxy_to_xywh(bx.cols(*_B)), F.col("pk") % 360 / 180.0 * math.pi)
    return table(s, d, "gt").select("image_id", "gt_id", *[F.round(v, 4).alias(n) for v, n in zip(b, _B, strict=True)])


def points_scaled_back(s, d):
    p = bx.scale_points_back(_POINTS(), *WH(), F.lit(640.0), F.lit(640.0))
    at = lambda i, c: F.round(F.get(p, F.lit(i))[c], 4).alias(f"{c}{i}")
    return table(s, d, "gt").select("image_id", "gt_id", at(0, "x"), at(0, "y"), at(2, "x"), at(2, "y"))


def points_flipped(s, d):
    p = au.flip_points(_POINTS(), *WH(), [1, 0, 3, 2])
    at = lambda i, c: F.get(p, F.lit(i))[c].alias(f"{c}{i}")
    return table(s, d, "gt").select("image_id", "gt_id", at(0, "x"), at(0, "y"), at(1, "x"), at(3, "y"))


def points_warped(s, d):
    """A projective map of each label's corners, and their enclosing box."""
    p = au.warp_points(_POINTS(), [[0.9, 0.1, -20.0], [-0.05, 1.1, 10.0], [0.0001, 0.0002, 1.0]])
    return table(s, d, "gt").withColumn("p", p).select("image_id", "gt_id", *[F.round(v, 4).alias(n) for v, n in zip(shapes.bounds(F.col("p")), _B, strict=True)])


def points_uncropped(s, d):
    p = tiling.uncrop_points(_POINTS(), F.col("pk") % 100, F.lit(7.0))
    return table(s, d, "gt").select("image_id", "gt_id", F.get(p, F.lit(1))["x"].cast("double").alias("x"), F.get(p, F.lit(2))["y"].alias("y"))


def segments_resampled(s, d):
    """Outlines of six points; their length and area come from the points."""
    ring = kernels.resample_column(_POINTS(), 6)
    rows = table(s, d, "gt").select("image_id", "gt_id", ring.alias("p"))
    at = lambda i, c: F.round(F.get("p", F.lit(i))[c], 4).alias(f"{c}{i}")
    return rows.select("image_id", "gt_id", F.size("p").alias("n"), at(1, "x"), at(2, "y"), at(4, "x"))


def segments_measured(s, d):
    rows = table(s, d, "gt").withColumn("p", _POINTS())
    box = shapes.bounds(F.col("p"))
    return rows.select("image_id", "gt_id", shapes.ring_area(F.col("p")).alias("area"), shapes.ring_length(F.col("p")).alias("length"), box[0].alias("x1"), box[3].alias("y2"))


def cover_union(s, d):
    """Labels of which two overlapping rectangles together hide under 60%."""
    return spatial.cover_union(table(s, d, "gt"), [(300.0, 200.0, 600.0, 500.0), (500.0, 100.0, 800.0, 400.0)], 0.6).select("image_id", "gt_id")


def tiles_row_major(s, d):
    """The 2 by 2 grid in the order of files on disk: by row, then column."""
    return tiling.grid_2x2(table(s, d, "images"), order=((0, 0), (0, 1), (1, 0), (1, 1))).select("image_id", "k", "x0", "y0", "x1", "y1")


def tiles_multi_scale(s, d):
    images = table(s, d, "images").select("image_id", "w", "h")
    return tiling.multi_scale(images, (0.5, 1.0), 512, 100).select("image_id", "scale", "x0", "y0", F.round("rate", 6).alias("rate"))


def label_paths(s, d):
    return table(s, d, "images").select("image_id", labels.label_path(F.concat(F.lit("/data/images/a/"), "im_file")).alias("path"))


def label_counters(s, d):
    """Found, missing, empty and corrupt label files of all images; some files are written empty or broken."""
    images, gt = T(s, d, "images", "gt")
    b = bx.normalise(bx.xyxy_to_xywh(bx.cols(*_B)), *WH())
    rows = gt.select("image_id", "gt_id", "cls", *[F.least(F.lit(1.0), v).alias(n) for v, n in zip(b, ("cx", "cy", "w", "h"), strict=True)])
    texts = labels.lines(rows, "image_id", ["gt_id"]).join(images.select("image_id", "im_file"), "image_id")
    value = F.when(F.col("image_id") % 10 == 0, "").when(F.col("image_id") % 10 == 1, F.concat("text", F.lit("\n9 2 0 0 0"))).otherwise(F.col("text"))
    files = texts.select(labels.label_path(F.concat(F.lit("/d/"), "im_file")).alias("path"), value.alias("value"))
    return labels.counters(images.select(F.concat(F.lit("/d/"), "im_file").alias("im_file")), labels.parse(files, 6))


def pose_lines(s, d):
    """Label lines with two key points, written and parsed again."""
    b = bx.normalise(bx.xyxy_to_xywh(bx.cols(*_B)), *WH())
    six = lambda v: F.format_string("%.6f", v)
    line = F.concat_ws(" ", F.col("cls").cast("string"), *[six(F.least(F.lit(1.0), v)) for v in b], six(F.col("x1") / 1200), six(F.col("y1") / 900), (F.col("pk") % 3).cast("string"), six(F.lit(0.5)), six(F.lit(0.25)), F.lit("2"))
    files = table(s, d, "gt").select(F.concat_ws("/", "image_id", "gt_id").alias("path"), line.alias("value"))
    rows = labels.poses(labels.parse(files, 6, keypoints=(2, 3)), 3)
    return rows.select("path", "cls", F.get("kpts", F.lit(0))["v"].cast("int").alias("v0"), F.get("kpts", F.lit(0))["x"].alias("x0"), F.get("kpts", F.lit(1))["y"].alias("y1"))


def coco_round_trip(s, d):
    """A ground-truth document written from the labels, its annotations read back."""
    rows = annotations.coco_document(*T(s, d, "images", "gt"), NAMES)
    a = rows.where("kind = 'annotation'").select(F.from_json("value", "id long, image_id long, category_id int, bbox array<double>, area double, iscrowd int").alias("a")).select("a.*")
    return a.select("id", "image_id", "category_id", F.get("bbox", F.lit(2)).alias("width"), "area")


def even_subset(s, d):
    """Sixty label rows evenly spaced over the order of class and id, so that every class is there."""
    return sampling.evenly_spaced(read(s, d, "labels").select("quality", "doc_id"), ["quality", "doc_id"], 60)


def extracted_frames(s, d):
    """Every third frame of each track as a video, numbered through all of them."""
    frames = table(s, d, "points").select(F.lpad(F.col("track_id").cast("string"), 8, "0").alias("path"), "frame")
    return datasets.extracted(frames, 3, 7)


def saved_once(s, d):
    """Each (class, part) of an image once, 50 a class."""
    rows = table(s, d, "gt").select("image_id", "gt_id", "cls", (F.col("pk") % 2).alias("part"))
    return datasets.capped(rows, ["image_id", "cls", "part"], "cls", 50, ["image_id", "gt_id"])


def log_runs(s, d):
    """Runs of equal events of each user."""
    return datasets.condensed(table(s, d, "points").select(F.col("track_id").alias("source"), F.col("frame").alias("n"), F.col("cls").alias("line")))


def eval_class_table(s, d):
    """Precision, recall and F1 of each class at the best mean F1, with its AP: a validation's table."""
    pred, gt = T(s, d, "pred", "gt")
    points = ev.ranked_curve(ev.ranked(pred, gt))
    curves = settled(ev.confidence_curves(points, gt))
    mean = ev.smooth(curves.groupBy("k").agg(F.avg("f1").alias("f1")), "k", "f1", 1000, 0.1, "smooth")
    best = mean.agg(F.max_by("k", F.struct(F.round("smooth", 9), -F.col("k"))).alias("k"))
    ap = ev.average_precision(points, gt).groupBy("cls").agg(F.max(F.when(F.col("thr") == 0.5, F.col("ap"))).alias("ap50"), F.avg("ap").alias("ap"))
    rows = curves.join(F.broadcast(best), "k").join(ap, "cls").select("cls", "p", "r", "f1", "ap50", "ap")
    return ev.rounded(rows, "p", "r", "f1", "ap50", "ap")


def eval_sizes(s, d):
    """Average precision by size of object (small, medium, large and all), ignoring what is outside the range. Beyond SQL; tests have a brute-force twin."""
    return ev.rounded(ev.sized_precision(*T(s, d, "pred", "gt")), "ap", "ap50")


def _tracked(rules):
    return lambda s, d: tracked(s, d, rules)


QUERIES = {f.__name__: f for f in (box_ltwh, box_enclosing, points_scaled_back, points_flipped, points_warped, points_uncropped, segments_resampled, segments_measured, cover_union, tiles_row_major, tiles_multi_scale, label_paths, label_counters, pose_lines, coco_round_trip, even_subset, extracted_frames, saved_once, log_runs, eval_class_table, eval_sizes)}
QUERIES |= {"tracks_camera_filter": _tracked(tracker.BOT), "tracks_observation": _tracked(tracker.OC), "tracks_hidden": _tracked(tracker.FAST)}

_G, _I, _P = ctes("gt"), ctes("images"), ctes("points")
_SCALE = "640 / 1200.0::double as g, round_even((640 - round_even(900 * (640 / 1200.0::double), 0)) / 2 - 0.1::double, 0) as py, round_even((640 - round_even(1200 * (640 / 1200.0::double), 0)) / 2 - 0.1::double, 0) as px"
_TURN = "(x1 + x2) / 2 as x, (y1 + y2) / 2 as y, x2 - x1 as w, y2 - y1 as h"
_STEPS = lambda n, s, crop, step: f"(select unnest(list_distinct(list_transform(range(0, {n}), lambda i: case when i * {step} + {crop} > {s} and {n} > 1 then {s} - {crop} else i * {step}.0 end))) as v)"

SQL = {
    "box_ltwh": f'{_G} select image_id, gt_id, x1 as "left", y2 - y1 as height, x2 as "right", y2 as bottom, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, x1, y2 from gt',
    "box_enclosing": f"""{_G}, t as (select image_id, gt_id, {_TURN}, pk % 360 / 180.0::double * {math.pi!r}::double as th from gt), c as (select *, (abs(w * cos(th)) + abs(h * sin(th))) / 2 as rx, (abs(w * sin(th)) + abs(h * cos(th))) / 2 as ry from t)
      select image_id, gt_id, round(x - rx, 4) as x1, round(y - ry, 4) as y1, round(x + rx, 4) as x2, round(y + ry, 4) as y2 from c""",
    "points_scaled_back": f"{_G}, k as (select *, {_SCALE} from gt) select image_id, gt_id, round(greatest(0, least((x1 - px) / g, 1200)), 4) as x0, round(greatest(0, least((y1 - py) / g, 900)), 4) as y0, round(greatest(0, least((x2 - px) / g, 1200)), 4) as x2, round(greatest(0, least((y2 - py) / g, 900)), 4) as y2 from k",
    "points_flipped": f"{_G} select image_id, gt_id, 1200 - x2 as x0, 900 - y1 as y0, 1200 - x1 as x1, 900 - y2 as y3 from gt",
    "points_warped": f"""{_G}, c as (select image_id, gt_id, px, py, 1e-4::double * px + 2e-4::double * py + 1 as z from (select image_id, gt_id, unnest([x1, x2, x2, x1]) as px, unnest([y1, y1, y2, y2]) as py from gt)), m as (select image_id, gt_id, (0.9::double * px + 0.1::double * py - 20) / z as x, (-0.05::double * px + 1.1::double * py + 10) / z as y from c)
      select image_id, gt_id, round(min(x), 4) as x1, round(min(y), 4) as y1, round(max(x), 4) as x2, round(max(y), 4) as y2 from m group by 1, 2""",
    "points_uncropped": f"{_G} select image_id, gt_id, x2 + pk % 100 as x, y2 + 7 as y from gt",
    "segments_resampled": f"{_G} select image_id, gt_id, 6 as n, round(x1 + 0.8::double * (x2 - x1), 4) as x1, round(y1 + 0.6::double * (y2 - y1), 4) as y2, round(x1, 4) as x4 from gt",
    "segments_measured": f"{_G} select image_id, gt_id, (x2 - x1) * (y2 - y1) as area, 2 * (x2 - x1) + 2 * (y2 - y1) as length, x1, y2 from gt",
    "cover_union": f"""{_G}, a as (select *, greatest(0, least(x2, 600) - greatest(x1, 300)) * greatest(0, least(y2, 500) - greatest(y1, 200)) + greatest(0, least(x2, 800) - greatest(x1, 500)) * greatest(0, least(y2, 400) - greatest(y1, 100)) - greatest(0, least(x2, 600) - greatest(x1, 500)) * greatest(0, least(y2, 400) - greatest(y1, 200)) as hidden from gt)
      select image_id, gt_id from a where hidden / ((x2 - x1) * (y2 - y1)) < 0.6""",
    "tiles_row_major": f"{_I}, t as (select *, floor(w * 1.2::double / 2) as sw, floor(h * 1.2::double / 2) as sh from images) select image_id, k, case when k % 2 = 1 then w - sw else 0.0 end as x0, case when k > 1 then h - sh else 0.0 end as y0, case when k % 2 = 1 then w else sw end as x1, case when k > 1 then h else sh end as y1 from t, (values (0), (1), (2), (3)) o(k)",
    "tiles_multi_scale": f"""{_I}, w as (select 1.0::double as scale, x.v as x0, y.v as y0, (least(x.v + 512, 1200) - x.v) * (least(y.v + 512, 900) - y.v) / 262144.0::double as rate from {_STEPS("3", "1200.0", 512, 412)} x, {_STEPS("2", "900.0", 512, 412)} y
      union all select 0.5, x.v, y.v, (least(x.v + 1024, 1200) - x.v) * (least(y.v + 1024, 900) - y.v) / 1048576.0::double from {_STEPS("2", "1200.0", 1024, 824)} x, {_STEPS("1", "900.0", 1024, 824)} y)
      select image_id, scale, x0, y0, round(rate, 6) as rate from images, w where rate > 0.6""",
    "label_paths": f"{_I} select image_id, '/data/images/a/labels/' || image_id || '.txt' as path from images",
    "label_counters": f"{ctes('images', 'gt')}, i as (select image_id, image_id in (select image_id from gt) as has from images) select count(*) filter (where has and image_id % 10 <> 1) as found, count(*) filter (where not has) as missing, count(*) filter (where has and image_id % 10 = 0) as empty, count(*) filter (where has and image_id % 10 = 1) as corrupt from i",
    "pose_lines": f"{_G} select image_id || '/' || gt_id as path, cls, cast(pk % 3 as int) as v0, round(x1 / 1200, 6) as x0, 0.25::double as y1 from gt",
    "coco_round_trip": f"{_G} select image_id * 4294967296 + gt_id + 1 as id, image_id, cls + 1 as category_id, x2 - x1 as width, (x2 - x1) * (y2 - y1) as area from gt",
    "even_subset": "with r as (select quality, doc_id, row_number() over (order by quality, doc_id) - 1 as a, count(*) over () as n from labels) select quality, doc_id from r where a in (select i * (n - 1) // 59 from range(0, 60) t(i))",
    "extracted_frames": f"{_P}, f as (select lpad(cast(track_id as varchar), 8, '0') as path, frame from points where (frame - 1) % 3 = 0) select lpad(cast(row_number() over (order by path, frame) as varchar), 7, '0') as name, path, frame from f",
    "saved_once": f"""{_G}, o as (select image_id, gt_id, cls, pk % 2 as part, row_number() over (partition by image_id, cls, pk % 2 order by gt_id) as n from gt), c as (select *, row_number() over (partition by cls order by image_id, gt_id) as m from o where n = 1) select image_id, gt_id, cls, part from c where m <= 50""",
    "log_runs": f"{_P}, n as (select *, case when lag(cls) over w is not distinct from cls and lag(frame) over w is not null then 0 else 1 end as fresh from points window w as (partition by track_id order by frame)), r as (select *, sum(fresh) over (partition by track_id order by frame) as run from n) select track_id as source, cast(run as bigint) as run, min(cls) as line, count(*) as times from r group by 1, 2",
    "eval_class_table": f"""with a as ({ctes("pred", "gt")}, {eq.AP} select cls, round(max(ap) filter (where thr = 0.5), 6) as ap50, round(avg(ap), 6) as ap from ap group by cls), b as ({eq.SQL["eval_best_f1"]}) select cls, p, r, f1, ap50, ap from a join b using (cls)""",
}
