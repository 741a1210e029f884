"""Label-side augmentation and further spatial joins over the canonical tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import boxes as bx
from tessera.functions import kernels
from tessera.functions import shapes as sh
from tessera.operators import augment as au
from tessera.operators import evaluation as ev
from tessera.operators import spatial as sp
from tessera.operators import suppress, tiling
from tessera.sources import annotations, dota, labels
from tessera.storage import written
from tessera.streaming import tracker

from .canonical import ctes, read, table
from .tiling_queries import TILES

T = lambda s, d, *names: [table(s, d, n) for n in names]
W, H = 1200.0, 900.0


def _partners(s, d):
    """Each image with the label-bearing image 7 keys on, where there is one."""
    ids = table(s, d, "gt").select("image_id").distinct()
    return ids.select("image_id", (F.col("image_id") + 7).alias("partner")).join(ids.withColumnRenamed("image_id", "partner"), "partner").select("image_id", "partner")


def flip_boxes(s, d):
    return au.flip_ud(au.flip_lr(table(s, d, "gt"), F.lit(W)), F.lit(H)).select("image_id", "gt_id", "x1", "y1", "x2", "y2")


def mosaic_labels(s, d):
    images, gt = T(s, d, "images", "gt")
    return au.mosaic4(gt, images, 800.0)


def mixup_labels(s, d):
    return au.mixup(table(s, d, "gt"), _partners(s, d)).groupBy("image_id", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum("x1").alias("x1"))


def cut_mix_labels(s, d):
    cut = tuple(F.lit(v) for v in (500.0, 350.0, 800.0, 600.0))
    return au.cut_mix(table(s, d, "gt"), _partners(s, d), cut)


def copy_paste_labels(s, d):
    return au.copy_paste(table(s, d, "gt"), _partners(s, d)).select("image_id", "origin", "gt_id")


def warp_boxes(s, d):
    return ev.rounded(au.warp(table(s, d, "gt"), (0.9, 0.1, -50.0, -0.05, 0.8, 30.0), W, H), "x1", "y1", "x2", "y2", places=4)


def pool_route(s, d):
    return au.route_pool(s.range(41 * 5).select(F.col("id").alias("idx")).where("idx < 203"), 20)


def occlusion_cover(s, d):
    return sp.cover(table(s, d, "gt"), 300.0, 200.0, 600.0, 500.0, 0.6).select("image_id", "gt_id")


def assign_hungarian(s, d):
    """Matched pairs and total IoU of each image under optimal assignment."""
    return sp.optimal_match(*T(s, d, "pred", "gt")).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("iou"), 6).alias("iou"))


def assign_aligned(s, d):
    return ev.rounded(sp.aligned_candidates(*T(s, d, "pred", "gt"), k=3), "metric")


def keypoint_oks(s, d):
    g = table(s, d, "gt")
    point = lambda x, y, v: F.struct(x.alias("x"), y.alias("y"), v.alias("v"))
    a = F.array(point(F.col("x1"), F.col("y1"), F.col("pk") % 3), point(F.col("x2"), F.col("y1"), F.col("pk") % 2), point(F.col("x2"), F.col("y2"), F.lit(1).cast("long")))
    b = F.array(point(F.col("x1") + 3, F.col("y1"), F.lit(1)), point(F.col("x2"), F.col("y1") + F.col("pk") % 5, F.lit(1)), point(F.col("x2") - 2, F.col("y2") + 1, F.lit(1)))
    return g.select("image_id", "gt_id", F.round(sp.keypoint_similarity(a, b, bx.area(bx.cols("x1", "y1", "x2", "y2")) * 0.53, [0.05, 0.1, 0.08]), 6).alias("oks"))


def _masks(df, key, *others):
    """Rectangles as masks over cells of 20 pixels."""
    cell = lambda c: F.floor(F.col(c) / 20)
    shape = F.struct(*[cell(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")])
    return df.select("image_id", F.col(key), shape.alias("shape"), (cell("x1") * 1000 + cell("y1")).alias("first"), (cell("x2") * 1000 + cell("y2")).alias("last"), *others)


def _cells(shape):
    """A rectangle's cells, column by column."""
    return F.flatten(F.transform(F.sequence(shape["x1"], shape["x2"]), lambda x: F.sequence(x * 1000 + shape["y1"], x * 1000 + shape["y2"])))


def mask_iou_pairs(s, d):
    pred, gt = T(s, d, "pred", "gt")
    a, b = _masks(pred, "det_id").withColumnRenamed("det_id", "a"), _masks(gt, "gt_id").withColumnRenamed("gt_id", "b")
    return ev.rounded(sp.mask_iou(a, b, _cells), "iou")


def track_duplicates(s, d):
    pred = table(s, d, "pred").select(F.col("image_id").alias("stream_id"), F.col("det_id").alias("track_id"), F.round(F.col("conf") * 10).cast("int").alias("age"), "x1", "y1", "x2", "y2")
    a, b = sp.duplicate_tracks(pred.where("track_id < 100"), pred.where("track_id >= 100"))
    return a.unionByName(b).select("stream_id", "track_id")


def prompt_masks(s, d):
    pred, gt = T(s, d, "pred", "gt")
    return sp.select_by_prompts(pred, gt)


def mined_detections(s, d):
    pred = table(s, d, "pred")
    return sp.mined_low_scores(suppress.fast_nms(pred, 0.9), suppress.fast_nms(pred, 0.5), 0.6).select("image_id", "det_id")


def max_det_guard(s, d):
    n = table(s, d, "gt").groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.max("n").alias("most"), F.count(F.when(F.col("n") > 5, 1)).alias("beyond"))


def pose_angles(s, d):
    p = table(s, d, "points")
    angle = sh.joint_angle(F.col("x"), F.col("y"), F.lit(320.0), F.lit(240.0), F.lit(640.0), F.lit(240.0))
    return p.select("track_id", "frame", F.round(angle, 5).alias("angle"), F.round(sh.centroid_distance(F.col("x") + 0.7, F.col("y") + 0.2, F.lit(3.9), F.lit(4.1)), 6).alias("distance"))


def label_lines_scan(s, d):
    """Label texts written from the boxes and parsed again, by status and class."""
    b = bx.normalise(bx.xyxy_to_xywh(bx.cols("x1", "y1", "x2", "y2")), F.lit(W), F.lit(H))
    rows = table(s, d, "gt").select("image_id", "gt_id", "cls", *[v.alias(n) for v, n in zip(b, ("cx", "cy", "w", "h"), strict=True)])
    texts = labels.lines(rows, "image_id", ["gt_id"]).select(F.col("image_id").cast("string").alias("path"), F.col("text").alias("value"))
    return labels.boxes(labels.parse(texts, 6)).groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 1).alias("w"))


def predictions_json(s, d):
    rows = table(s, d, "pred").withColumn("file_name", F.concat(F.lit("im/"), F.col("image_id"), F.lit(".jpg")))
    parsed = annotations.predictions_json(rows).select(F.from_json("value", annotations.PREDICTION).alias("p")).select("p.*")
    return parsed.select("image_id", "category_id", "score", F.get("bbox", F.lit(0)).alias("left"), F.get("bbox", F.lit(2)).alias("width"))


def annotation_ids(s, d):
    return annotations.annotation_ids(table(s, d, "gt")).select("image_id", "gt_id", "annotation_id")


def epoch_rows(s, d):
    """Result rows of runs with different metrics in one table, missing ones null."""
    e = read(s, d, "events")
    a = e.where("event_type = 'click'").select("event_id", F.col("value").alias("map"))
    return a.unionByName(e.where("event_type = 'view'").select("event_id", F.col("value").alias("loss")), allowMissingColumns=True)


def whole_and_sliced(s, d):
    """Sliced metrics beside the same ones over whole images."""
    pred, gt = T(s, d, "pred", "gt")
    one = lambda p, name: p.agg(F.count(F.lit(1)).alias(name))
    hits = ev.match(pred, gt, [0.5])
    sliced = ev.match(suppress.fast_nms(pred, 0.5), gt, [0.5])
    return one(sliced, "tp").join(F.broadcast(one(hits, "whole_tp")), F.lit(True))


def best_run(s, d):
    """The best row of each run by fitness, and its three best parents."""
    w = Window.partitionBy("track_id").orderBy(F.desc("value"), "frame")
    rows = table(s, d, "points").withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    return rows.groupBy("track_id").agg(F.max(F.when(F.col("rank") == 1, F.col("frame"))).alias("best"), F.round(F.sum("value"), 4).alias("weight"))


def depth_calibration(s, d):
    """Mean log ratio of true and predicted depth by fold, and how often it brings a pixel within 1.25 on the others."""
    px = read(s, d, "events").where("value > 0").select((F.col("event_id") % 5).alias("fold"), F.col("value").alias("t"), (F.col("value") * 1.3 + F.col("event_id") % 7 * 0.1).alias("p"))
    folds = px.groupBy("fold").agg(F.sum(F.log("t") - F.log("p")).alias("s"), F.count(F.lit(1)).alias("n"))
    total = px.agg(F.sum(F.log("t") - F.log("p")).alias("all_s"), F.count(F.lit(1)).alias("all_n"))
    fit = folds.join(F.broadcast(total), F.lit(True)).select("fold", ((F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n"))).alias("b"))
    rows = px.join(F.broadcast(fit), "fold").withColumn("q", F.col("p") * F.exp("b"))
    good = F.avg((F.greatest(F.col("q") / F.col("t"), F.col("t") / F.col("q")) < 1.25).cast("double"))
    plain = F.avg((F.greatest(F.col("p") / F.col("t"), F.col("t") / F.col("p")) < 1.25).cast("double"))
    return rows.groupBy("fold").agg(F.round(F.max("b"), 6).alias("b"), F.round(good, 6).alias("scaled"), F.round(plain, 6).alias("identity"))


def _ring(*names):
    x1, y1, x2, y2 = (F.col(n) for n in names)
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))])


def window_iof(s, d):
    """Share of each label's polygon in every tile of its image that it meets."""
    images, gt = T(s, d, "images", "gt")
    t = tiling.grid_2x2(images).select("image_id", "k", "x0", "y0", F.col("x1").alias("tx"), F.col("y1").alias("ty"))
    rows = gt.join(t, "image_id").where("x1 < tx and x2 > x0 and y1 < ty and y2 > y0")
    return rows.select("image_id", "gt_id", "k", F.round(kernels.iof_column(_ring("x1", "y1", "x2", "y2"), F.array("x0", "y0", "tx", "ty")) + 1e-9, 6).alias("iof"))


def least_rectangles(s, d):
    """Rectangles of least area around the corners of rotated boxes: the boxes' own sides come back."""
    theta = (F.col("pk") % 50 + 1) / 40.0
    c = bx.corners(*bx.xyxy_to_xywh(bx.cols("x1", "y1", "x2", "y2")), theta)
    r = table(s, d, "gt").select("image_id", "gt_id", kernels.rectangle_column(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in c])).alias("r"))
    return r.select("image_id", "gt_id", F.round(F.greatest("r.w", "r.h"), 4).alias("longer"), F.round(F.least("r.w", "r.h"), 4).alias("shorter"), F.round("r.cx", 4).alias("cx"))


def dota_merge(s, d):
    """Rotated predictions of tiles, named by offset, merged on their images."""
    b = bx.xyxy_to_xywh(bx.cols("x1", "y1", "x2", "y2"))
    tile = dota.tile_name(F.col("image_id").cast("string"), 1.0, F.col("det_id") % 2 * 100, F.lit(50))
    rows = table(s, d, "pred").select(tile.alias("tile"), "det_id", "cls", "conf", (b[0] - F.col("det_id") % 2 * 100).alias("cx"), (b[1] - 50).alias("cy"), b[2].alias("w"), b[3].alias("h"), (F.col("det_id") % 5 / 10.0).alias("theta"))
    return dota.merge(rows).select(F.col("image").cast("long").alias("image_id"), "det_id")


def tracked(s, d, rules):
    """A tracker over detections of four streams; frames count a stream's images.

    They are counted as they come to the tracker, sorted: streams are dealt out and sorted once.
    """
    rows = written(table(s, d, "pred", dealt=True).select("image_id", "det_id", "cls", "conf", "x1", "y1", "x2", "y2"))
    frame = F.coalesce("image_id", F.lit(0))  # without an image there is no stream either, and one frame
    return tracker.track_table(rows.withColumns({"stream_id": F.col("image_id") % 4, "frame": frame}), rules, counted=True)


def tracks_table(s, d):
    """Beyond SQL."""
    return tracked(s, d, tracker.BYTE)


_ALL = (flip_boxes, mosaic_labels, mixup_labels, cut_mix_labels, copy_paste_labels, warp_boxes, pool_route, occlusion_cover, assign_hungarian, assign_aligned, keypoint_oks, mask_iou_pairs, track_duplicates, prompt_masks, mined_detections, max_det_guard, pose_angles, window_iof, least_rectangles, dota_merge, label_lines_scan, predictions_json, annotation_ids, epoch_rows, whole_and_sliced, best_run, depth_calibration, tracks_table)
QUERIES = {f.__name__: f for f in _ALL}

_G, _P, _PG = ctes("gt"), ctes("points"), ctes("pred", "gt")
_PART = f"{_G}, partners as (select image_id, image_id + 7 as partner from (select distinct image_id from gt) where image_id + 7 in (select image_id from gt))"
_IOU = "(greatest(0, least(p.x2, q.x2) - greatest(p.x1, q.x1)) * greatest(0, least(p.y2, q.y2) - greatest(p.y1, q.y1)))"
_AREA = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))".format
_U = f"({_AREA('p')} + {_AREA('q')} - {_IOU} + 1e-7::double)"
_FAST = lambda t: f"select * from pred p where not exists (select 1 from pred q where q.image_id = p.image_id and q.cls = p.cls and (q.conf > p.conf or (q.conf = p.conf and q.det_id < p.det_id)) and {_IOU} / ({_AREA('p')} + {_AREA('q')} - {_IOU}) >= {t})"
_HIT = lambda src: f"select image_id, gt_id from (select *, row_number() over (partition by image_id, gt_id order by conf desc, det_id) as r2 from (select p.image_id, p.det_id, p.conf, q.gt_id, row_number() over (partition by p.image_id, p.det_id order by {_IOU} / {_U} desc, q.gt_id) as r1, {_IOU} / {_U} as iou from {src} p join gt q on p.image_id = q.image_id and p.cls = q.cls and {_IOU} / {_U} >= 0.5) where r1 = 1) where r2 = 1"
_PX = lambda t, k: f"select image_id, mask, cx * 1000 + unnest(range(a, b + 1)) as px from (select image_id, {k} as mask, unnest(range(cast(floor(x1 / 20) as bigint), cast(floor(x2 / 20) as bigint) + 1)) as cx, cast(floor(y1 / 20) as bigint) as a, cast(floor(y2 / 20) as bigint) as b from {t})"

SQL = {
    "flip_boxes": f"{_G} select image_id, gt_id, 1200 - x2 as x1, 900 - y2 as y1, 1200 - x1 as x2, 900 - y1 as y2 from gt",
    "mosaic_labels": f"""{ctes("images", "gt")}, r as (select image_id, row_number() over (order by image_id) - 1 as r from images), p as (select image_id, r // 4 as canvas, case when r % 2 = 0 then -400.0 else 800.0 end as dx, case when r % 4 < 2 then -100.0 else 800.0 end as dy from r),
      b as (select canvas, image_id, gt_id, cls, greatest(0.0, least(x1 + dx, 1600.0)) as x1, greatest(0.0, least(y1 + dy, 1600.0)) as y1, greatest(0.0, least(x2 + dx, 1600.0)) as x2, greatest(0.0, least(y2 + dy, 1600.0)) as y2 from gt join p using (image_id)) select * from b where x2 > x1 and y2 > y1""",
    "mixup_labels": f"{_PART}, u as (select image_id, cls, x1 from gt union all select p.image_id, g.cls, g.x1 from gt g join partners p on g.image_id = p.partner) select image_id, cls, count(*) as n, sum(x1) as x1 from u group by 1, 2",
    "cut_mix_labels": f"""{_PART}, i as (select *, greatest(0, least(x2, 800) - greatest(x1, 500)) * greatest(0, least(y2, 600) - greatest(y1, 350)) as inter from gt)
      select p.image_id, p.partner as origin, gt_id, cls, greatest(x1, 500.0) as x1, greatest(y1, 350.0) as y1, least(x2, 800.0) as x2, least(y2, 600.0) as y2 from i join partners p on i.image_id = p.partner where inter / ((x2 - x1) * (y2 - y1)) >= 0.1 and p.image_id not in (select image_id from i where inter > 0)""",
    "copy_paste_labels": f"{_PART} select n.image_id, n.partner as origin, p.gt_id from gt p join partners n on p.image_id = n.partner where not exists (select 1 from gt q where q.image_id = n.image_id and {_IOU} / ({_AREA('q')} + 1e-7::double) >= 0.3)",
    "warp_boxes": f"""{_G}, c as (select *, [0.9::double * x1 + 0.1::double * y1 - 50, 0.9::double * x1 + 0.1::double * y2 - 50, 0.9::double * x2 + 0.1::double * y1 - 50, 0.9::double * x2 + 0.1::double * y2 - 50] as xs, [-0.05::double * x1 + 0.8::double * y1 + 30, -0.05::double * x1 + 0.8::double * y2 + 30, -0.05::double * x2 + 0.8::double * y1 + 30, -0.05::double * x2 + 0.8::double * y2 + 30] as ys from gt),
      k as (select image_id, gt_id, cls, (x2 - x1) * (y2 - y1) as a, greatest(0, least(list_min(xs), 1200)) as x1, greatest(0, least(list_min(ys), 900)) as y1, greatest(0, least(list_max(xs), 1200)) as x2, greatest(0, least(list_max(ys), 900)) as y2 from c)
      select image_id, gt_id, cls, round(x1, 4) as x1, round(y1, 4) as y1, round(x2, 4) as x2, round(y2, 4) as y2 from k where x2 - x1 > 2 and y2 - y1 > 2 and (x2 - x1) * (y2 - y1) / (a * 0.725::double) > 0.1 and greatest((x2 - x1) / (y2 - y1), (y2 - y1) / (x2 - x1)) < 100""",
    "pool_route": """select idx, case when idx < 80 then 'base' when idx < 100 then 'origin' when idx < 120 then 'ratio' when idx < 160 then 'blur' when idx < 165 then 'compose' when idx < 185 then 'weather' when idx < 205 then 'occlusion' end as segment,
      case when idx < 80 then idx // 4 when idx < 100 then idx - 80 when idx < 120 then idx - 100 when idx < 160 then (idx - 120) % 20 when idx < 165 then (idx - 160) * 4 % 20 when idx < 185 then idx - 165 else idx - 185 end as image,
      case when idx < 80 then idx % 4 when idx between 120 and 159 then (idx - 120) // 20 else 0 end as part from range(0, 203) t(idx)""",
    "occlusion_cover": f"{_G} select image_id, gt_id from gt where greatest(0, least(x2, 600) - greatest(x1, 300)) * greatest(0, least(y2, 500) - greatest(y1, 200)) / ((x2 - x1) * (y2 - y1)) < 0.6",
    "assign_hungarian": f"""{_PG.replace("with ", "with recursive ")}, j as (select p.image_id, p.det_id, q.gt_id, {_IOU} / {_U} as iou from pred p join gt q on p.image_id = q.image_id and p.cls = q.cls), c as (select *, count(*) over (partition by image_id, det_id) as nd, count(*) over (partition by image_id, gt_id) as ng from j where iou >= 0.5),
      lone as (select image_id, count(*) as n, sum(iou) as s from c where nd = 1 and ng = 1 group by 1), hard as (select *, dense_rank() over (partition by image_id order by det_id) as k from c where nd > 1 or ng > 1),
      options as (select image_id, k, gt_id, iou from hard union all select distinct image_id, k, cast(null as int), 0.0::double from hard), top as (select image_id, max(k) as top from hard group by 1),
      walk as (select image_id, 0::bigint as k, 0::bigint as used, 0.0::double as s, 0::bigint as n from top union all
        select w.image_id, o.k, case when o.gt_id is null then w.used else w.used | (1::bigint << o.gt_id) end, w.s + o.iou, w.n + case when o.gt_id is null then 0 else 1 end from walk w join options o on o.image_id = w.image_id and o.k = w.k + 1 and (o.gt_id is null or (w.used & (1::bigint << o.gt_id)) = 0)),
      best as (select image_id, max(w.s) as s, arg_max(w.n, w.s) as n from walk w join top using (image_id) where w.k = top group by 1)
      select image_id, cast(sum(n) as bigint) as n, round(sum(s), 6) as iou from (select image_id, n, s from lone union all select image_id, n, s from best where n > 0) group by image_id""",
    "assign_aligned": f"""{_PG}, c as (select p.image_id, p.det_id, q.gt_id, {_IOU} / {_U} as iou, sqrt(p.conf) * pow({_IOU} / {_U}, 6) as metric from pred p join gt q on p.image_id = q.image_id and (p.x1 + p.x2) / 2 > q.x1 and (p.x1 + p.x2) / 2 < q.x2 and (p.y1 + p.y2) / 2 > q.y1 and (p.y1 + p.y2) / 2 < q.y2),
      k as (select * from (select *, row_number() over (partition by image_id, gt_id order by metric desc, det_id) as r from c) where r <= 3) select image_id, det_id, gt_id, round(metric, 6) as metric from (select *, row_number() over (partition by image_id, det_id order by iou desc, gt_id) as n from k) where n = 1""",
    "keypoint_oks": f"""{_G}, k as (select *, (x2 - x1) * (y2 - y1) * 0.53::double + 1e-7::double as a from gt), v as (select image_id, gt_id, list_filter([case when pk % 3 > 0 then exp(-9.0 / pow(2 * 0.05::double, 2) / a / 2) end, case when pk % 2 > 0 then exp(-((pk % 5) * (pk % 5)) / pow(2 * 0.1::double, 2) / a / 2) end, exp(-5.0 / pow(2 * 0.08::double, 2) / a / 2)], lambda x: x is not null) as l from k)
      select image_id, gt_id, round(list_sum(l) / len(l), 6) as oks from v""",
    "mask_iou_pairs": f"""{_PG}, a as ({_PX('pred', 'det_id')}), b as ({_PX('gt', 'gt_id')}), j as (select image_id, a.mask as a, b.mask as b, count(*) as n from a join b using (image_id, px) group by 1, 2, 3)
      select j.image_id, j.a, j.b, round(n / ((select count(*) from a x where x.image_id = j.image_id and x.mask = j.a) + (select count(*) from b y where y.image_id = j.image_id and y.mask = j.b) - n)::double, 6) as iou from j""",
    "track_duplicates": f"""{ctes("pred")}, t as (select *, cast(round(conf * 10) as int) as age from pred), n as (select p.image_id, p.det_id as a, q.det_id as b, p.age as aa, q.age as ab from t p join t q on p.image_id = q.image_id and p.det_id < 100 and q.det_id >= 100 and 1 - {_IOU} / {_U} < 0.15)
      select image_id as stream_id, det_id as track_id from t where not exists (select 1 from n where n.image_id = t.image_id and ((aa <= ab and a = det_id) or (aa > ab and b = det_id)))""",
    "prompt_masks": f"{_PG}, m as (select p.image_id, p.det_id, row_number() over (partition by q.image_id, q.gt_id order by {_IOU} / {_U} desc, p.det_id) as r from pred p join gt q on p.image_id = q.image_id) select distinct image_id, det_id from m where r = 1",
    "mined_detections": f"{ctes('pred')}, loose as ({_FAST('0.9')}), tight as ({_FAST('0.5')}) select image_id, det_id from loose where conf < 0.6 and (image_id, det_id) not in (select image_id, det_id from tight)",
    "max_det_guard": f"{_G}, n as (select count(*) as n from gt group by image_id) select max(n) as most, count(*) filter (where n > 5) as beyond from n",
    "pose_angles": f"{_P}, a as (select track_id, frame, degrees(abs(0 - atan2(y - 240, x - 320))) as a, x, y from points) select track_id, frame, round(case when a > 180 then 360 - a else a end, 5) as angle, round(sqrt(pow(floor(x + 0.7) - 3, 2) + pow(floor(y + 0.2) - 4, 2)), 6) as distance from a",
    "window_iof": f"""{ctes("images", "gt")}, {TILES}, j as (select g.image_id, gt_id, k, greatest(0, least(g.x2, t.x1) - greatest(g.x1, t.x0)) * greatest(0, least(g.y2, t.y1) - greatest(g.y1, t.y0)) as inter, (g.x2 - g.x1) * (g.y2 - g.y1) as own from gt g join tiles t using (image_id))
      select image_id, gt_id, k, round(inter / own + 1e-9::double, 6) as iof from j where inter > 0""",
    "least_rectangles": f"{_G} select image_id, gt_id, round(greatest(x2 - x1, y2 - y1), 4) as longer, round(least(x2 - x1, y2 - y1), 4) as shorter, round((x1 + x2) / 2, 4) as cx from gt",
    "dota_merge": f"""{ctes("pred")}, g as (select image_id, det_id, cls, conf, image_id || '__1.0__' || (det_id % 2 * 100) || '___50' as tile, (x1 + x2) / 2 as x, (y1 + y2) / 2 as y, (x2 - x1) * (x2 - x1) / 12 as a, (y2 - y1) * (y2 - y1) / 12 as b, det_id % 5 / 10.0::double as t from pred),
      k as (select *, a * cos(t) * cos(t) + b * sin(t) * sin(t) as a1, a * sin(t) * sin(t) + b * cos(t) * cos(t) as b1, (a - b) * cos(t) * sin(t) as c1 from g),
      j as (select p.image_id, p.det_id, q.x - p.x as dx, p.y - q.y as dy, p.a1 + q.a1 as a, p.b1 + q.b1 as b, p.c1 + q.c1 as c, (p.a1 * p.b1 - p.c1 * p.c1) as d1, (q.a1 * q.b1 - q.c1 * q.c1) as d2 from k p join k q on p.image_id = q.image_id and p.cls = q.cls and abs(p.x - q.x) < 500 and abs(p.y - q.y) < 500 and (q.conf > p.conf or (q.conf = p.conf and (q.tile, q.det_id) < (p.tile, p.det_id)))),
      f as (select image_id, det_id, (a * dy * dy + b * dx * dx) / (a * b - c * c + 1e-7::double) * 0.25 + c * dx * dy / (a * b - c * c + 1e-7::double) * 0.5 + ln((a * b - c * c) / (4 * sqrt(greatest(0, d1) * greatest(0, d2)) + 1e-7::double) + 1e-7::double) * 0.5 as bd from j)
      , gone as (select distinct image_id, det_id from f where 1 - sqrt(1 - exp(-least(100.0, greatest(1e-7::double, bd))) + 1e-7::double) >= 0.3)
      select image_id, det_id from pred anti join gone using (image_id, det_id)""",
    "label_lines_scan": f"{_G} select cls, count(*) as n, round(sum((x2 - x1) / 1200), 1) as w from gt g where not exists (select 1 from gt h where h.image_id = g.image_id and ((x1 + x2) / 2 / 1200 > 1.01 or (y1 + y2) / 2 / 900 > 1.01)) group by cls",
    "predictions_json": f"{ctes('pred')} select image_id, cls as category_id, round(conf, 5) as score, round(x1, 3) as \"left\", round(x2 - x1, 3) as width from pred",
    "annotation_ids": f"{_G} select image_id, gt_id, image_id * 4294967296 + gt_id + 1 as annotation_id from gt",
    "epoch_rows": "select event_id, case when event_type = 'click' then value end as map, case when event_type = 'view' then value end as loss from events where event_type in ('click', 'view')",
    "whole_and_sliced": f"{_PG}, kept as ({_FAST('0.5')}) select (select count(*) from ({_HIT('kept')})) as tp, (select count(*) from ({_HIT('pred')})) as whole_tp",
    "best_run": f"{_P}, r as (select *, row_number() over (partition by track_id order by value desc, frame) as rank from points) select track_id, max(frame) filter (where rank = 1) as best, round(sum(value) filter (where rank <= 3), 4) as weight from r group by track_id",
    "depth_calibration": """with px as (select event_id % 5 as fold, value as t, value * 1.3::double + event_id % 7 * 0.1::double as p from events where value > 0), f as (select fold, (select avg(ln(t) - ln(p)) from px o where o.fold <> g.fold) as b from (select distinct fold from px) g), q as (select px.*, b, p * exp(b) as q from px join f using (fold))
      select fold, round(max(b), 6) as b, round(avg(cast(greatest(q / t, t / q) < 1.25 as double)), 6) as scaled, round(avg(cast(greatest(p / t, t / p) < 1.25 as double)), 6) as identity from q group by fold""",
}
