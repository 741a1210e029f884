"""Track, region and vector analytics over the canonical tables, with DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.functions import boxes as bx
from tessera.functions import shapes as sh
from tessera.operators import evaluation as ev
from tessera.operators import tracks as tr
from tessera.operators import vectors as ve

from .canonical import ctes, read, table

LINE_V, LINE_H = [(320.0, 0.0), (320.0, 480.0)], [(0.0, 240.0), (640.0, 240.0)]
REGION = [(220.0, 140.0), (420.0, 140.0), (420.0, 340.0), (220.0, 340.0)]
REGIONS = {"a": REGION, "b": [(0.0, 0.0), (320.0, 0.0), (0.0, 320.0)]}
P = lambda s, d: table(s, d, "points")


def track_previous(s, d):
    return tr.with_previous(P(s, d)).select("track_id", "frame", "x", "y", "px", "py")


def track_history(s, d):
    rows = tr.history(P(s, d))
    return rows.select("track_id", "frame", F.size("history").alias("n"), F.aggregate("history", F.lit(0.0), lambda a, p: a + p["x"]).alias("sum_x"))


def track_line_vertical(s, d):
    return tr.line_crossings(P(s, d), LINE_V)


def track_line_horizontal(s, d):
    return tr.line_crossings(P(s, d), LINE_H)


def track_region_entries(s, d):
    return tr.region_entries(P(s, d), REGION)


def track_region_counts(s, d):
    return tr.region_counts(P(s, d), REGIONS)


def track_queue_counts(s, d):
    return tr.region_counts(P(s, d), {"a": REGION}, need_previous=True)


def track_parking(s, d):
    return tr.slot_occupancy(P(s, d), REGIONS)


def track_speed(s, d):
    return tr.speeds(P(s, d))


def track_reps(s, d):
    return tr.stage_repetitions(P(s, d), F.col("value"), 40.0, 10.0).groupBy("track_id").agg(F.max("reps").alias("reps"))


def track_ema(s, d):
    return tr.ema(P(s, d), "x", 0.9)


def track_alarm(s, d):
    return tr.alarms(P(s, d), 10)


def track_class_counts(s, d):
    return tr.class_counts(P(s, d), 10)


def track_heatmap(s, d):
    return tr.heatmap(table(s, d, "gt"), 50)


def track_joint(s, d):
    rows = P(s, d).where("frame = 1").select("track_id", "x")
    return tr.joint_by_id(rows.where("track_id % 2 = 0"), rows.where("track_id % 3 = 0").withColumn("x", F.col("x") + 1000))


def vector_top_k(s, d):
    e = read(s, d, "embeddings")
    return ve.top_k(e.where("vec_id % 100 = 0"), e, 5, 0.2)


def vector_norms(s, d):
    return ve.norms(read(s, d, "embeddings"))


def box_formats(s, d):
    g, b = table(s, d, "gt"), bx.cols("x1", "y1", "x2", "y2")
    xywh, ltwh = bx.xyxy_to_xywh(b), bx.xyxy_to_ltwh(b)
    n = bx.normalise(xywh, F.lit(1200.0), F.lit(900.0))
    back = bx.denormalise(n, F.lit(1200.0), F.lit(900.0))
    clip = bx.clip(b, F.lit(800.0), F.lit(600.0))
    snap = bx.snap(b, F.lit(1200.0), F.lit(900.0), 100.0)
    out = {"cx": xywh[0], "cy": xywh[1], "bw": ltwh[2], "bh": ltwh[3], "nx": F.round(n[0], 6), "ny": F.round(n[1], 6), "back": F.round(back[2], 4), "clip_x": clip[2], "clip_y": clip[3], "snap_x": snap[0], "snap_y": snap[1], "a": bx.area(b)}
    return g.select("image_id", "gt_id", *[v.alias(k) for k, v in out.items()])


def box_scale_back(s, d):
    b = bx.scale_back(bx.cols("x1", "y1", "x2", "y2"), F.lit(1200.0), F.lit(900.0), F.lit(640.0), F.lit(640.0))
    return table(s, d, "gt").select("image_id", "gt_id", *[F.round(v, 4).alias(n) for v, n in zip(b, ("x1", "y1", "x2", "y2"), strict=True)])


def box_rotated(s, d):
    g, b = table(s, d, "gt"), bx.xyxy_to_xywh(bx.cols("x1", "y1", "x2", "y2"))
    theta = F.col("pk") % 360 / 180.0 * math.pi
    c, r = bx.corners(*b, theta), bx.regularise(b[2], b[3], theta)
    return g.select("image_id", "gt_id", F.round(c[0][0], 4).alias("ax"), F.round(c[0][1], 4).alias("ay"), F.round(c[2][0], 4).alias("cx"), F.round(F.greatest(*[p[0] for p in c]), 4).alias("right"), F.round(r[2], 6).alias("theta"), F.round(r[0], 4).alias("w"))


def _neighbours(s, d):
    g = table(s, d, "gt")
    h = g.select("image_id", (F.col("gt_id") - 1).alias("gt_id"), *[F.col(c).alias(f"q{c}") for c in ("x1", "y1", "x2", "y2")])
    return g.join(h, ["image_id", "gt_id"])


def box_extended_iou(s, d):
    a, b = bx.cols("x1", "y1", "x2", "y2"), bx.cols("qx1", "qy1", "qx2", "qy2")
    return _neighbours(s, d).select("image_id", "gt_id", *[F.round(v, 6).alias(k) for k, v in bx.extended_iou(a, b).items()], F.round(bx.ioa(a, b), 6).alias("ioa"))


def box_prob_iou(s, d):
    a, b = bx.xyxy_to_xywh(bx.cols("x1", "y1", "x2", "y2")), bx.xyxy_to_xywh(bx.cols("qx1", "qy1", "qx2", "qy2"))
    return _neighbours(s, d).select("image_id", "gt_id", F.round(bx.prob_iou((*a, F.col("pk") % 7 / 10.0), (*b, F.lit(0.3))), 5).alias("prob"))


def box_candidates(s, d):
    """Boxes that keep enough width, area and shape after a shrink to a canvas of 400 pixels."""
    c = bx.clip(bx.cols("x1", "y1", "x2", "y2"), F.lit(400.0), F.lit(400.0))
    w, h = c[2] - c[0], c[3] - c[1]
    shape = F.greatest(w / (h + 1e-16), h / (w + 1e-16))
    ok = (w > 2) & (h > 2) & (w * h / (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")) > 0.1) & (shape < 100)
    return table(s, d, "gt").where(ok).select("image_id", "gt_id")


def box_near_crop_edge(s, d):
    """Boxes within 20 pixels of the edge of the crop (100, 100, 700, 500), but not of the image."""
    crop, image = (100.0, 100.0, 700.0, 500.0), (0.0, 0.0, 1200.0, 900.0)
    close = lambda c, v: F.abs(F.col(c) - v) <= 20
    hit = F.lit(False)
    for c, a, b in zip(("x1", "y1", "x2", "y2"), crop, image, strict=True):
        hit = hit | (close(c, a) & ~close(c, b))
    return table(s, d, "gt").where(hit).select("image_id", "gt_id")


def confidence_bands(s, d):
    return table(s, d, "pred").where("x2 > x1 and y2 > y1").groupBy(ev.confidence_band(F.col("conf")).alias("band"), "cls").agg(F.count(F.lit(1)).alias("n"))


def sigma_clip(s, d):
    """Values within two deviations of the mean, cut up to three times."""
    return ev.sigma_clip(read(s, d, "events").select("event_id", "value"), "value").select("event_id")


def category_frequency(s, d):
    rows = read(s, d, "part").select(F.explode(F.split("p_name", "[ /]")).alias("name"))
    return rows.groupBy(F.lower(F.trim("name")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def clean_names(s, d):
    return read(s, d, "part").select("p_partkey", sh.clean_str(F.concat("p_name", F.lit(":#"), "p_brand")).alias("name"), sh.make_divisible(F.col("p_size"), 32).alias("size"))


def dataset_report(s, d):
    images, gt = table(s, d, "images"), table(s, d, "gt").groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    return images.join(gt, "image_id", "left").agg(F.count(F.lit(1)).alias("images"), F.count("n").alias("labelled"), (F.count(F.lit(1)) - F.count("n")).alias("backgrounds"), F.sum("n").alias("instances"), F.max("n").alias("most"))


def label_histogram(s, d):
    b = bx.normalise(bx.xyxy_to_xywh(bx.cols("x1", "y1", "x2", "y2")), F.lit(1200.0), F.lit(900.0))
    return table(s, d, "gt").groupBy(F.floor(b[0] * 20).alias("bx"), F.floor(b[1] * 20).alias("by")).agg(F.count(F.lit(1)).alias("n"))


def rect_batches(s, d):
    """Batches of 16 in order of height over width, with the shape that fits each batch, in multiples of 32."""
    from tessera.operators.scans import global_rank

    shape = table(s, d, "gt").where("gt_id = 1").select("image_id", ((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))).alias("ar"))
    rows = global_rank(shape, "ar", "image_id").withColumn("batch", F.floor((F.col("rank") - 1) / 16))
    b = rows.groupBy("batch").agg(F.min("ar").alias("lo"), F.max("ar").alias("hi"))
    h = F.when(F.col("hi") < 1, F.col("hi")).otherwise(1.0)
    w = F.when(F.col("lo") > 1, 1 / F.col("lo")).otherwise(1.0)
    w = F.when(F.col("hi") < 1, 1.0).otherwise(w)
    return b.select("batch", (F.ceil(h * 640 / 32 + 0.5) * 32).cast("long").alias("h"), (F.ceil(w * 640 / 32 + 0.5) * 32).cast("long").alias("w"))


def early_stopping(s, d):
    """Best epoch so far and whether to stop, for a fitness series made of event values."""
    from pyspark.sql import Window

    rows = table(s, d, "points").select("track_id", "frame", F.col("value").alias("fitness"))
    w = Window.partitionBy("track_id").orderBy("frame")
    best = F.max("fitness").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("better", best.isNull() | (F.col("fitness") > best) | (best == 0))
    rows = rows.withColumn("best", F.last(F.when(F.col("better"), F.col("frame")), ignorenulls=True).over(w))
    return rows.select("track_id", "frame", "best", (F.col("frame") - F.col("best") >= 3).alias("stop"))


def background_class_map(s, d):
    """Class names with a background class added where there is more than one class."""
    n = table(s, d, "gt").select(F.col("cls")).distinct()
    names = n.select(F.col("cls").cast("long").alias("id"), F.concat(F.lit("class"), F.col("cls")).alias("name"))
    return names.unionByName(n.agg(F.count(F.lit(1)).alias("id")).where("id > 1").select("id", F.lit("background").alias("name")))


_NAMES = (track_previous, track_history, track_line_vertical, track_line_horizontal, track_region_entries, track_region_counts, track_queue_counts, track_parking, track_speed, track_reps, track_ema, track_alarm, track_class_counts, track_heatmap, track_joint, vector_top_k, vector_norms, box_formats, box_scale_back, box_rotated, box_extended_iou, box_prob_iou, box_candidates, box_near_crop_edge, confidence_bands, sigma_clip, category_frequency, clean_names, dataset_report, label_histogram, rect_batches, early_stopping, background_class_map)
QUERIES = {f.__name__: f for f in _NAMES}

_P, _G = ctes("points"), ctes("gt")
_PREV = f"{_P}, prev as (select *, lag(x) over w as px, lag(y) over w as py from points window w as (partition by track_id order by frame))"
_IN = "(x > 220 and x < 420 and y > 140 and y < 340)"
_TRI = "(x + y < 320 and x > 0 and y > 0)"
_TRI_EDGE = "(x + y <= 320 and x >= 0 and y >= 0)"
_SQ_EDGE = "(x >= 220 and x <= 420 and y >= 140 and y <= 340)"
_NB = f"""{_G}, n as (select g.*, h.x1 as qx1, h.y1 as qy1, h.x2 as qx2, h.y2 as qy2 from gt g join gt h on g.image_id = h.image_id and g.gt_id = h.gt_id - 1)"""

SQL = {
    "track_previous": f"{_PREV} select track_id, frame, x, y, px, py from prev",
    "track_history": f"{_P} select track_id, frame, cast(count(*) over w as int) as n, sum(x) over w as sum_x from points window w as (partition by track_id order by frame rows between 29 preceding and current row)",
    "track_line_vertical": f"{_PREV}, c as (select * from prev where px is not null and ((px <= 320 and x >= 320) or (px >= 320 and x <= 320))) select track_id, frame, case when x > px then 'in' else 'out' end as direction from (select *, row_number() over (partition by track_id order by frame) as n from c) where n = 1",
    "track_line_horizontal": f"{_PREV}, c as (select * from prev where px is not null and ((py <= 240 and y >= 240) or (py >= 240 and y <= 240))) select track_id, frame, case when y > py then 'in' else 'out' end as direction from (select *, row_number() over (partition by track_id order by frame) as n from c) where n = 1",
    "track_region_entries": f"""{_P}, l as (select *, lag(x) over w as px, lag(y) over w as py, {_IN} as i0, lag({_IN}) over w as was,
        list(struct_pack(x := x, y := y, i := {_IN})) over (partition by track_id order by frame rows between 4 preceding and current row) as trail from points window w as (partition by track_id order by frame)),
      t as (select *, case when x = px then case when x > 220 and x < 420 then 0 else 2 end else least((220 - px) / (x - px), (420 - px) / (x - px)) end as tx0, case when x = px then 1 else greatest((220 - px) / (x - px), (420 - px) / (x - px)) end as tx1,
        case when y = py then case when y > 140 and y < 340 then 0 else 2 end else least((140 - py) / (y - py), (340 - py) / (y - py)) end as ty0, case when y = py then 1 else greatest((140 - py) / (y - py), (340 - py) / (y - py)) end as ty1 from l where px is not null),
      c as (select *, greatest(0, tx0, ty0) as lo, least(1, tx1, ty1) as hi from t),
      e as (select *, row_number() over (partition by track_id order by frame) as n, coalesce(list_filter(trail, lambda p: not p.i)[1], trail[1]) as base from c where i0 or (not was and lo < hi and (lo > 0 or hi < 1)))
      select track_id, frame, case when case when abs(x - base.x) > abs(y - base.y) then x > base.x else y > base.y end then 'in' else 'out' end as direction from e where n = 1""",
    "track_region_counts": f"{_P} select frame, 'a' as region, count(*) as n from points where {_IN} group by frame union all select frame, 'b', count(*) from points where {_TRI} group by frame",
    "track_queue_counts": f"{_PREV} select frame, 'a' as region, count(*) as n from prev where px is not null and {_IN} group by frame",
    "track_parking": f"""{_P} select frame, cast(cast(bool_or({_SQ_EDGE}) as int) + cast(bool_or({_TRI_EDGE}) as int) as bigint) as occupied, cast(2 - cast(bool_or({_SQ_EDGE}) as int) - cast(bool_or({_TRI_EDGE}) as int) as bigint) as free from points group by frame""",
    "track_speed": f"""{_P} select a.track_id, least(120, cast(floor(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) * 0.05::double / ((b.frame - a.frame) / 30.0::double) * 3.6::double) as int)) as speed from points a join points b on a.track_id = b.track_id and a.frame = 1 and b.frame = 5""",
    "track_reps": f"""{_P}, st as (select track_id, frame, last_value(case when value > 40 then 'up' when value < 10 then 'down' end ignore nulls) over (partition by track_id order by frame) as stage from points),
      t as (select track_id, case when stage = 'up' and lag(stage) over (partition by track_id order by frame) = 'down' then 1 else 0 end as t from st) select track_id, cast(sum(t) as bigint) as reps from t group by track_id""",
    "track_ema": f"""{_P.replace("with ", "with recursive ")}, e as (select track_id, frame, x as smooth from points where frame = 1 union all select p.track_id, p.frame, 0.9::double * e.smooth + (1 - 0.9::double) * p.x from e join points p on p.track_id = e.track_id and p.frame = e.frame + 1) select track_id, frame, smooth from e""",
    "track_alarm": f"{_P}, c as (select frame, count(*) as n from points group by frame having count(*) >= 10) select frame, n from c order by frame limit 1",
    "track_class_counts": f"{_P}, c as (select frame // 10 as bin, cls, count(*) as n from points group by 1, 2) select bin, cls, n, round(n / sum(n) over (partition by bin) * 100, 6) as share from c",
    "track_heatmap": f"""{_G}, b as (select (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, least(x2 - x1, y2 - y1) / 2 as r, unnest(range(cast(floor(x1 / 50) as bigint), cast(floor(x2 / 50) as bigint) + 1)) as px, y1, y2 from gt),
      c as (select *, unnest(range(cast(floor(y1 / 50) as bigint), cast(floor(y2 / 50) as bigint) + 1)) as py from b) select px, py, count(*) * 2 as heat from c where (px * 50 - cx) * (px * 50 - cx) + (py * 50 - cy) * (py * 50 - cy) <= r * r group by px, py""",
    "track_joint": f"{_P} select track_id, case when track_id % 2 = 0 then x else x + 1000 end as x from points where frame = 1 and (track_id % 2 = 0 or track_id % 3 = 0)",
    "vector_top_k": """with s as (select q.vec_id as query_id, b.vec_id, round(list_cosine_similarity(q.embedding::double[], b.embedding::double[]), 6) as score from embeddings q join embeddings b on q.vec_id % 100 = 0 and q.vec_id <> b.vec_id)
      select query_id, vec_id, rank, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5 and score >= 0.2""",
    "vector_norms": """with o as (select vec_id, i, embedding[i] as x, row_number() over (partition by vec_id order by embedding[i] desc, i) as rk from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings))
      select vec_id, round(sqrt(sum(x::double * x::double)), 5) as norm, cast(min(i) filter (where rk = 1) - 1 as int) as top1, string_agg(cast(i - 1 as varchar), ',' order by rk) filter (where rk <= 5) as top5 from o group by vec_id""",
    "box_formats": f"""{_G} select image_id, gt_id, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, x2 - x1 as bw, y2 - y1 as bh, round((x1 + x2) / 2 / 1200, 6) as nx, round((y1 + y2) / 2 / 900, 6) as ny, round(x2, 4) as back,
      greatest(0.0, least(x2, 800.0)) as clip_x, greatest(0.0, least(y2, 600.0)) as clip_y, case when x1 < 100 then 0.0 else x1 end as snap_x, case when y1 < 100 then 0.0 else y1 end as snap_y, (x2 - x1) * (y2 - y1) as a from gt""",
    "box_scale_back": f"""{_G}, k as (select *, 640 / 1200.0::double as g, round_even((640 - round_even(900 * (640 / 1200.0::double), 0)) / 2 - 0.1::double, 0) as py, round_even((640 - round_even(1200 * (640 / 1200.0::double), 0)) / 2 - 0.1::double, 0) as px from gt)
      select image_id, gt_id, round(greatest(0, least((x1 - px) / g, 1200)), 4) as x1, round(greatest(0, least((y1 - py) / g, 900)), 4) as y1, round(greatest(0, least((x2 - px) / g, 1200)), 4) as x2, round(greatest(0, least((y2 - py) / g, 900)), 4) as y2 from k""",
    "box_rotated": f"""{_G}, t as (select *, (x1 + x2) / 2 as x, (y1 + y2) / 2 as y, x2 - x1 as w, y2 - y1 as h, pk % 360 / 180.0::double * {math.pi!r}::double as th from gt), c as (select *, w / 2 * cos(th) as ux, w / 2 * sin(th) as uy, -h / 2 * sin(th) as vx, h / 2 * cos(th) as vy from t)
      select image_id, gt_id, round(x + ux + vx, 4) as ax, round(y + uy + vy, 4) as ay, round(x - ux - vx, 4) as cx, round(greatest(x + ux + vx, x + ux - vx, x - ux - vx, x - ux + vx), 4) as "right", round(th % {math.pi / 2!r}::double, 6) as theta, round(case when th % {math.pi!r}::double >= {math.pi / 2!r}::double then h else w end, 4) as w from c""",
    "box_extended_iou": f"""{_NB}, a as (select *, x2 - x1 as wa, y2 - y1 + 1e-7::double as ha, qx2 - qx1 as wb, qy2 - qy1 + 1e-7::double as hb, greatest(0, least(x2, qx2) - greatest(x1, qx1)) * greatest(0, least(y2, qy2) - greatest(y1, qy1)) as inter, greatest(x2, qx2) - least(x1, qx1) as cw, greatest(y2, qy2) - least(y1, qy1) as ch from n),
      b as (select *, wa * ha + wb * hb - inter + 1e-7::double as u, cw * ch + 1e-7::double as hull, cw * cw + ch * ch + 1e-7::double as span, ((qx1 + qx2 - x1 - x2) * (qx1 + qx2 - x1 - x2) + (qy1 + qy2 - y1 - y2) * (qy1 + qy2 - y1 - y2)) / 4 as apart, {4 / math.pi**2!r}::double * pow(atan(wb / hb) - atan(wa / ha), 2) as v from a)
      select image_id, gt_id, round(inter / u - (hull - u) / hull, 6) as giou, round(inter / u - apart / span, 6) as diou, round(inter / u - (apart / span + v * (v / (v - inter / u + (1 + 1e-7::double)))), 6) as ciou, round(inter / ((qx2 - qx1) * (qy2 - qy1) + 1e-7::double), 6) as ioa from b""",
    "box_prob_iou": f"""{_NB}, g as (select *, (x2 - x1) * (x2 - x1) / 12 as pa, (y2 - y1) * (y2 - y1) / 12 as pb, pk % 7 / 10.0::double as t1, (qx2 - qx1) * (qx2 - qx1) / 12 as qa, (qy2 - qy1) * (qy2 - qy1) / 12 as qb, 0.3::double as t2 from n),
      h as (select *, pa * cos(t1) * cos(t1) + pb * sin(t1) * sin(t1) as a1, pa * sin(t1) * sin(t1) + pb * cos(t1) * cos(t1) as b1, (pa - pb) * cos(t1) * sin(t1) as c1, qa * cos(t2) * cos(t2) + qb * sin(t2) * sin(t2) as a2, qa * sin(t2) * sin(t2) + qb * cos(t2) * cos(t2) as b2, (qa - qb) * cos(t2) * sin(t2) as c2,
        (qx1 + qx2) / 2 - (x1 + x2) / 2 as dx, (y1 + y2) / 2 - (qy1 + qy2) / 2 as dy from g),
      k as (select *, a1 + a2 as a, b1 + b2 as b, c1 + c2 as c, (a1 + a2) * (b1 + b2) - (c1 + c2) * (c1 + c2) as det from h),
      f as (select *, (a * dy * dy + b * dx * dx) / (det + 1e-7::double) * 0.25 + c * dx * dy / (det + 1e-7::double) * 0.5 + ln(det / (4 * sqrt(greatest(0, a1 * b1 - c1 * c1) * greatest(0, a2 * b2 - c2 * c2)) + 1e-7::double) + 1e-7::double) * 0.5 as bd from k)
      select image_id, gt_id, round(1 - sqrt(1 - exp(-least(100.0, greatest(1e-7::double, bd))) + 1e-7::double), 5) as prob from f""",
    "box_candidates": f"""{_G}, c as (select *, greatest(0, least(x2, 400)) - greatest(0, least(x1, 400)) as w, greatest(0, least(y2, 400)) - greatest(0, least(y1, 400)) as h from gt) select image_id, gt_id from c where w > 2 and h > 2 and w * h / (x2 - x1) / (y2 - y1) > 0.1 and greatest(w / h, h / w) < 100""",
    "box_near_crop_edge": f"{_G} select image_id, gt_id from gt where (abs(x1 - 100) <= 20 and abs(x1) > 20) or (abs(y1 - 100) <= 20 and abs(y1) > 20) or (abs(x2 - 700) <= 20 and abs(x2 - 1200) > 20) or (abs(y2 - 500) <= 20 and abs(y2 - 900) > 20)",
    "confidence_bands": f"{ctes('pred')} select case when conf >= 0.25 then 'high' when conf > 0.1 and conf < 0.25 then 'low' else 'none' end as band, cls, count(*) as n from pred where x2 > x1 and y2 > y1 group by 1, 2",
    "sigma_clip": """with a as (select event_id, value as v, avg(value) over () as m, stddev_pop(value) over () as sd from events), b as (select event_id, v, avg(v) over () as m, stddev_pop(v) over () as sd from a where abs(v - m) <= 2 * sd),
      c as (select event_id, v, avg(v) over () as m, stddev_pop(v) over () as sd from b where abs(v - m) <= 2 * sd) select event_id from c where abs(v - m) <= 2 * sd""",
    "category_frequency": "select lower(trim(name)) as name, count(*) as n from (select unnest(string_split_regex(p_name, '[ /]')) as name from part) group by 1",
    "clean_names": "select p_partkey, regexp_replace(p_name || ':#' || p_brand, '[|@#!¡·$€%&()=?¿^*;:,¨`><+]', '_', 'g') as name, cast(ceil(p_size / 32) * 32 as bigint) as size from part",
    "dataset_report": f"{ctes('images', 'gt')}, n as (select image_id, count(*) as n from gt group by image_id) select count(*) as images, count(n) as labelled, count(*) - count(n) as backgrounds, cast(sum(n) as bigint) as instances, max(n) as most from images left join n using (image_id)",
    "label_histogram": f"{_G} select cast(floor((x1 + x2) / 2 / 1200 * 20) as bigint) as bx, cast(floor((y1 + y2) / 2 / 900 * 20) as bigint) as by, count(*) as n from gt group by 1, 2",
    "rect_batches": f"""{_G}, r as (select (y2 - y1) / (x2 - x1) as ar, (row_number() over (order by (y2 - y1) / (x2 - x1), image_id) - 1) // 16 as batch from gt where gt_id = 1), b as (select batch, min(ar) as lo, max(ar) as hi from r group by batch)
      select batch, cast(ceil(case when hi < 1 then hi else 1 end * 640 / 32 + 0.5) * 32 as bigint) as h, cast(ceil(case when hi < 1 then 1 when lo > 1 then 1 / lo else 1 end * 640 / 32 + 0.5) * 32 as bigint) as w from b""",
    "early_stopping": f"""{_P}, r as (select track_id, frame, value as f, max(value) over (partition by track_id order by frame rows between unbounded preceding and 1 preceding) as b from points),
      s as (select track_id, frame, max(case when b is null or f > b or b = 0 then frame end) over (partition by track_id order by frame) as best from r) select track_id, frame, best, frame - best >= 3 as stop from s""",
    "background_class_map": f"{_G} select cast(cls as bigint) as id, 'class' || cls as name from (select distinct cls from gt) union all select count(distinct cls), 'background' from gt having count(distinct cls) > 1",
}
