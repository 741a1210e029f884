"""Result tables, exports and post-processing over the canonical predictions, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import boxes as bx
from tessera.operators import evaluation as ev
from tessera.operators import results as rs
from tessera.operators import sampling, spatial, suppress
from tessera.operators import tracks as tr

from . import evaluation_queries as eq
from .augment_queries import _PX, _cells, _masks
from .canonical import CLASSES, ctes, read, table

NAMES = {i: f"class{i}" for i in range(CLASSES)}
T = lambda s, d, *names: [table(s, d, n) for n in names]
WH = lambda: (F.lit(1200.0), F.lit(900.0))


def results_accessors(s, d):
    rows = rs.accessors(table(s, d, "pred"), *WH())
    first = lambda c, i: F.round(F.get(c, F.lit(i)), 6).alias(f"{c}_{i}")
    return rows.select("image_id", "det_id", first("xyxy", 0), first("xywh", 0), first("xywh", 3), first("xyxyn", 2), first("xywhn", 1), first("xywhn", 2))


def results_summary(s, d):
    return rs.summary(table(s, d, "pred"), NAMES, *WH()).select("image_id", "det_id", "name", "class", "confidence", "box.*")


def results_json(s, d):
    """Summaries as JSON lines, read back."""
    rows = rs.summary(table(s, d, "pred"), NAMES)
    return rs.json_lines(rows).select(F.from_json("value", rows.schema).alias("r")).select("r.image_id", "r.det_id", "r.name", "r.confidence", "r.box.x1")


def results_csv(s, d):
    """Summaries as CSV lines, nested columns as text, read back."""
    rows = rs.summary(table(s, d, "pred"), NAMES)
    flat = rs.csv_lines(rows).select(F.from_csv("value", "image_id long, det_id int, name string, class int, confidence double, box string").alias("r")).select("r.*")
    return flat.select("image_id", "det_id", "class", "confidence", F.get_json_object("box", "$.y2").cast("double").alias("y2"))


def results_log(s, d):
    return rs.log_lines(*T(s, d, "images", "pred"), NAMES)


def results_top5(s, d):
    """Five best of six pseudo-probabilities of each image."""
    gt = table(s, d, "gt").where("gt_id = 1")  # a row an image
    probs = F.array(*[((F.col("pk") * 31 + c * 17) % 101) / 101.0 for c in range(CLASSES)])
    return rs.top_classes(gt.select("image_id", probs.alias("probs")), NAMES)


def results_pixel_ratio(s, d):
    """Label areas as pixel counts; class 5 is left out as an ignored one."""
    px = table(s, d, "gt").select("image_id", "cls", (bx.area(bx.cols("x1", "y1", "x2", "y2"))).cast("long").alias("n"))
    return rs.pixel_ratio(px, {k: v for k, v in NAMES.items() if k < 5})


def class_ids_91(s, d):
    rows = s.range(0, 95).select(F.col("id").cast("int").alias("id"))
    return rows.select("id", rs.from_91(F.col("id")).alias("cls"), rs.to_91(F.when(F.col("id") < 80, F.col("id"))).alias("category"))


def label_remap(s, d):
    return table(s, d, "gt").groupBy(rs.remap(F.col("cls"), {0: 7, 2: 9, 4: 0}).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def stability_scores(s, d):
    return ev.rounded(rs.stability(read(s, d, "events").select(F.col("user_id").alias("mask"), F.col("value").alias("v")), 20.0, 5.0), "stability")


def set_decoder_boxes(s, d):
    b = bx.normalise(bx.xyxy_to_xywh(bx.cols("x1", "y1", "x2", "y2")), F.lit(1200.0), F.lit(1200.0))
    raw = table(s, d, "pred").select("image_id", "det_id", "cls", "conf", *[v.alias(n) for v, n in zip(b, ("cx", "cy", "w", "h"), strict=True)])
    return ev.rounded(rs.set_decoder(raw, 640.0, 0.25, 4), "x1", "y1", "x2", "y2", places=4)


def _scored(s, d):
    score = lambda c: ((F.col("det_id") * 37 + F.col("image_id") * 11 + c * 29) % 97) / 97.0
    return table(s, d, "pred").select("image_id", "det_id", "x1", "y1", "x2", "y2", F.array(*[score(c) for c in range(CLASSES)]).alias("scores"))


def raw_scores_best(s, d):
    """Raw boxes with class scores: the best class, then suppression."""
    return suppress.fast_nms(rs.best_class(_scored(s, d), 0.6), 0.5).select("image_id", "det_id", "cls", F.round("conf", 6).alias("conf"))


def raw_scores_every(s, d):
    return rs.every_class(_scored(s, d), 0.9).select("image_id", "det_id", "cls", F.round("conf", 6).alias("conf"))


def prompt_points(s, d):
    pred, gt = T(s, d, "pred", "gt")
    points = gt.select("image_id", F.col("gt_id").alias("place"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), (F.col("pk") % 3 > 0).cast("int").alias("label"))
    return rs.select_by_points(pred, points)


def _rotated(df):
    b = bx.xyxy_to_xywh(bx.cols("x1", "y1", "x2", "y2"))
    return df.withColumns({n: v for n, v in zip(("cx", "cy", "w", "h"), b, strict=True)} | {"theta": F.col("cls") / 10.0})


def eval_obb_ap(s, d):
    """Average precision of rotated boxes by probabilistic IoU."""
    pred, gt = T(s, d, "pred", "gt")
    points = ev.ranked_curve(ev.ranked(_rotated(pred), _rotated(gt), ev.rotated_pairs))
    return ev.rounded(ev.average_precision(points, gt), "ap", places=5)


def _mask_pairs(pred, gt, every=True):
    p = _masks(pred, "det_id", "conf", F.col("cls").alias("det_cls"))
    g = _masks(gt, "gt_id", F.col("cls").alias("gt_cls"))
    return spatial.mask_pairs(p, g, lambda *on: ev.beside(*on, True, every), _cells).select("image_id", "det_id", "conf", "gt_id", "iou", "det_cls", "gt_cls")


def eval_segment_metrics(s, d):
    """Box and mask families of a segmentation task side by side; fitness is their sum."""
    pred, gt = T(s, d, "pred", "gt")
    one = lambda score, tag: ev.mean_metrics(ev.average_precision(ev.ranked_curve(ev.ranked(pred, gt, score)), gt)).select(F.col("map50").alias(f"{tag}_map50"), F.col("map50_95").alias(f"{tag}_map"))
    both = one(ev.pairs, "box").join(F.broadcast(one(_mask_pairs, "mask")), F.lit(True))
    return ev.rounded(both.withColumn("fitness", F.col("box_map") + F.col("mask_map")), "box_map50", "box_map", "mask_map50", "mask_map", "fitness")


def eval_pose_matches(s, d):
    """Matches by keypoint similarity at three thresholds; key points are a box's corners and centre."""
    pred, gt = T(s, d, "pred", "gt")
    point = lambda x, y, v: F.struct(x.alias("x"), y.alias("y"), v.alias("v"))
    kpts = lambda v: F.array(point(F.col("x1"), F.col("y1"), v), point(F.col("x2"), F.col("y2"), F.lit(1)), point((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, F.lit(1)))
    p, g = pred.withColumn("kpts", kpts(F.lit(1))), gt.withColumn("kpts", kpts((F.col("pk") % 2).cast("int")))
    return ev.match_pairs(ev.keypoint_pairs(p, g, [0.05, 0.1, 0.08]), [0.5, 0.75, 0.9])


def eval_frequency_groups(s, d):
    """Mean AP of rare, common and frequent classes, by the number of images that have them."""
    pred, gt = T(s, d, "pred", "gt")
    ap = ev.average_precision(ev.ranked_curve(ev.ranked(pred, gt)), gt)
    images = table(s, d, "images").count()
    return ev.rounded(ev.by_frequency(ap, gt, round(images * 0.40), round(images * 0.44)), "ap")


def image_counts(s, d):
    """Labels of each image must number what the table of labels says."""
    gt = table(s, d, "gt")
    return gt.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("instances"), F.count(F.lit(1)).alias("images"))


def epoch_mask(s, d):
    return sampling.epoch_mask(table(s, d, "images").select("image_id"), "image_id", 0.3, "7", 2, 10, 3)


def grouped_order(s, d):
    """The pool's samples of each image in blocks, four images to a unit, units in random order, taken from in turn."""
    images = table(s, d, "images").select("image_id")
    pool = images.select("image_id", F.explode(F.sequence(F.lit(0), (F.col("image_id") % 3).cast("int"))).alias("k"))
    return sampling.grouped_order(pool, "image_id", "k", "5:0")


def repeated_samples(s, d):
    return sampling.repeated(table(s, d, "images").where("image_id % 7 = 0").select("image_id"), "image_id", 3, "9").select("image_id", "epoch", "rank")


def sample_counted(s, d):
    """A number of rows beats a share; a share gives one row at least."""
    images = table(s, d, "images").select("image_id")
    one = lambda tag, **how: sampling.ratio_or_count(images, "image_id", "3", **how).withColumn("tag", F.lit(tag))
    return one("count", ratio=0.5, count=17).unionByName(one("ratio", ratio=0.01)).unionByName(one("least", ratio=1e-9))


def collated(s, d):
    """Batches of 32 images: their boxes' rows with the image's place in its batch."""
    images, gt = T(s, d, "images", "gt")
    return sampling.collate(images.select("image_id"), gt.select("image_id", "gt_id", "cls"), "image_id", 32).select("batch", "batch_idx", "image_id", "gt_id", "cls")


def mosaic9_labels(s, d):
    from tessera.operators import augment as au

    return au.mosaic9(*T(s, d, "gt", "images"), 640.0)


def track_speed_steps(s, d):
    """Distance of each track's point to the frame's first track."""
    return ev.rounded(tr.distances(table(s, d, "points"), 10.0), "distance")


def track_costs(s, d):
    """Height-weighted overlap and confidence costs of predictions against label boxes taken as tracks."""
    pred, gt = T(s, d, "pred", "gt")
    return ev.rounded(spatial.track_costs(gt.withColumns({"score": F.lit(0.8), "prev_score": F.lit(0.7)}), pred), "cost")


def track_looks(s, d):
    """Costs of overlap and looks together; embeddings are dealt out to labels and predictions."""
    pred, gt = T(s, d, "pred", "gt")
    e = read(s, d, "embeddings").select("vec_id", "embedding")
    rows = ev.pairs(pred, gt, same_class=False).where("iou > 0.3").withColumns({"va": (F.col("det_id") * 13 + F.col("image_id")) % 500, "vb": (F.col("gt_id") * 13 + F.col("image_id")) % 500})
    rows = rows.join(e.toDF("va", "a"), "va", "left").join(e.toDF("vb", "b"), "vb", "left")
    cost = spatial.appearance_cost(F.col("iou"), F.col("a"), F.col("b"), 0.5, 0.55)
    return rows.select("image_id", "det_id", "gt_id", F.round(cost, 5).alias("cost"), F.round(spatial.fused_cost(F.col("iou"), F.col("conf")), 6).alias("fused"))


def text_prompts(s, d):
    from tessera.operators import generate as ge

    rows = ge.text_prompts(table(s, d, "gt"), NAMES, 4, 2, "11")
    return rows.select("image_id", F.array_join("classes", ",").alias("classes"), F.array_join("texts", ",").alias("texts"))


QUERIES = {f.__name__: f for f in (results_accessors, results_summary, results_json, results_csv, results_log, results_top5, results_pixel_ratio, class_ids_91, label_remap, stability_scores, set_decoder_boxes, raw_scores_best, raw_scores_every, prompt_points, eval_obb_ap, eval_segment_metrics, eval_pose_matches, eval_frequency_groups, image_counts, epoch_mask, grouped_order, repeated_samples, sample_counted, collated, mosaic9_labels, track_speed_steps, track_costs, track_looks, text_prompts)}

_PG, _G, _P, _I = ctes("pred", "gt"), ctes("gt"), ctes("pred"), ctes("images")
_SCORED = f"{_P}, raw as (select *, list_transform(range(0, 6), lambda c: ((det_id * 37 + image_id * 11 + c * 29) % 97) / 97.0::double) as scores from pred)"
_ROT = "x1, x2, y1, y2, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, (x2 - x1) * (x2 - x1) / 12 as sa, (y2 - y1) * (y2 - y1) / 12 as sb, cls / 10.0::double as t"
_OBB = f"""po as (select image_id, det_id, conf, cls, {_ROT} from pred), go as (select image_id, gt_id, cls, {_ROT} from gt),
  pc as (select *, sa * cos(t) * cos(t) + sb * sin(t) * sin(t) as a, sa * sin(t) * sin(t) + sb * cos(t) * cos(t) as b, (sa - sb) * cos(t) * sin(t) as c from po), gc as (select *, sa * cos(t) * cos(t) + sb * sin(t) * sin(t) as a, sa * sin(t) * sin(t) + sb * cos(t) * cos(t) as b, (sa - sb) * cos(t) * sin(t) as c from go),
  oj as (select p.image_id, det_id, conf, gt_id, p.cls as det_cls, g.cls as gt_cls, p.cx - g.cx as dx, g.cy - p.cy as dy, p.a + g.a as sa, p.b + g.b as sb, p.c + g.c as sc, greatest(0, g.a * g.b - g.c * g.c) * greatest(0, p.a * p.b - p.c * p.c) as own from pc p join gc g on p.image_id = g.image_id and p.cls = g.cls),
  od as (select *, sa * sb - sc * sc as det from oj),
  pairs as (select image_id, det_id, conf, gt_id, det_cls, gt_cls, 1 - sqrt(1 - exp(-least(100.0, greatest(1e-7::double, (sa * dy * dy + sb * dx * dx) / (det + 1e-7::double) * 0.25 + sc * dx * dy / (det + 1e-7::double) * 0.5 + ln(det / (4 * sqrt(own) + 1e-7::double) + 1e-7::double) * 0.5))) + 1e-7::double) as iou from od)"""
_MASK = f"""ma as ({_PX('pred', 'det_id')}), mb as ({_PX('gt', 'gt_id')}), mj as (select image_id, ma.mask as det_id, mb.mask as gt_id, count(*) as n from ma join mb using (image_id, px) group by 1, 2, 3),
  na as (select image_id, mask as det_id, count(*) as na from ma group by 1, 2), nb as (select image_id, mask as gt_id, count(*) as nb from mb group by 1, 2),
  pairs as (select mj.image_id, mj.det_id, p.conf, mj.gt_id, n / (na + nb - n)::double as iou, p.cls as det_cls, g.cls as gt_cls from mj join na using (image_id, det_id) join nb using (image_id, gt_id) join pred p using (image_id, det_id) join gt g using (image_id, gt_id))"""
_OKS = """ok as (select p.image_id, p.det_id, p.conf, g.gt_id, p.cls as det_cls, g.cls as gt_cls, (g.x2 - g.x1) * (g.y2 - g.y1) * 0.53::double + 1e-7::double as a, g.pk % 2 as v0,
    pow(g.x1 - p.x1, 2) + pow(g.y1 - p.y1, 2) as d0, pow(g.x2 - p.x2, 2) + pow(g.y2 - p.y2, 2) as d1, pow((g.x1 + g.x2) / 2 - (p.x1 + p.x2) / 2, 2) + pow((g.y1 + g.y2) / 2 - (p.y1 + p.y2) / 2, 2) as d2 from pred p join gt g on p.image_id = g.image_id and p.cls = g.cls),
  pairs as (select image_id, det_id, conf, gt_id, det_cls, gt_cls, (case when v0 > 0 then exp(-d0 / pow(2 * 0.05::double, 2) / a / 2) else 0 end + exp(-d1 / pow(2 * 0.1::double, 2) / a / 2) + exp(-d2 / pow(2 * 0.08::double, 2) / a / 2)) / (2 + v0) as iou from ok)"""
_HASH = "md5(concat(cast(image_id as varchar), ':{0}'))"
_BOX9 = "[[0, 0], [0, -1], [1, -1], [1, 0], [1, 1], [0, 1], [-1, 1], [-1, 0], [-1, -1]]"

SQL = {
    "results_accessors": f"{_P} select image_id, det_id, round(x1, 6) as xyxy_0, round((x1 + x2) / 2, 6) as xywh_0, round(y2 - y1, 6) as xywh_3, round(x2 / 1200, 6) as xyxyn_2, round((y1 + y2) / 2 / 900, 6) as xywhn_1, round((x2 - x1) / 1200, 6) as xywhn_2 from pred",
    "results_summary": f"{_P} select image_id, det_id, 'class' || cls as name, cls as class, round(conf, 5) as confidence, round(x1 / 1200, 5) as x1, round(y1 / 900, 5) as y1, round(x2 / 1200, 5) as x2, round(y2 / 900, 5) as y2 from pred",
    "results_json": f"{_P} select image_id, det_id, 'class' || cls as name, round(conf, 5) as confidence, round(x1, 5) as x1 from pred",
    "results_csv": f"{_P} select image_id, det_id, cls as class, round(conf, 5) as confidence, round(y2, 5) as y2 from pred",
    "results_log": f"""{ctes("images", "pred")}, c as (select image_id, cls, count(*) as n from pred group by 1, 2), l as (select image_id, string_agg(n || ' class' || cls || case when n > 1 then 's' else '' end || ', ', '' order by cls) as line from c group by 1)
      select image_id, coalesce(line, '(no detections), ') as line from images left join l using (image_id)""",
    "results_top5": f"{_G}, r as (select image_id, c, ((pk * 31 + c * 17) % 101) / 101.0::double as p, row_number() over (partition by image_id order by (pk * 31 + c * 17) % 101 desc, c) as rank from gt, range(0, 6) t(c) where gt_id = 1) select image_id, cast(rank as int) as rank, 'class' || c as name, cast(c as int) as class, round(p, 5) as confidence from r where rank <= 5",
    "results_pixel_ratio": f"{_G}, c as (select image_id, cls, sum(cast(trunc((x2 - x1) * (y2 - y1)) as bigint)) as n from gt group by 1, 2), r as (select *, round(n / sum(n) over (partition by image_id)::double, 5) as pixel_ratio from c) select image_id, 'class' || cls as name, cls as class, pixel_ratio from r where cls < 5",
    "class_ids_91": f"""with u as (select unnest({list(rs.UNUSED_IDS)}) as u), k as (select id, row_number() over (order by id) - 1 as cls from range(1, 92) t(id) where id not in (select u from u))
      select cast(i.id as int) as id, cast(k.cls as int) as cls, cast(q.id as int) as category from range(0, 95) i(id) left join k on k.id = i.id left join k q on q.cls = i.id""",
    "label_remap": f"{_G} select case cls when 0 then 7 when 2 then 9 when 4 then 0 else 255 end as label, count(*) as n from gt group by 1",
    "stability_scores": "select user_id as mask, round(count(*) filter (where value > 25) / nullif(count(*) filter (where value > 15), 0)::double, 6) as stability from events group by 1",
    "set_decoder_boxes": f"""{_P}, r as (select *, row_number() over (partition by image_id order by det_id) as rn from pred where conf > 0.25)
      select image_id, det_id, cls, conf, round(((x1 + x2) / 2 / 1200 - (x2 - x1) / 1200 / 2) * 640, 4) as x1, round(((y1 + y2) / 2 / 1200 - (y2 - y1) / 1200 / 2) * 640, 4) as y1, round(((x1 + x2) / 2 / 1200 + (x2 - x1) / 1200 / 2) * 640, 4) as x2, round(((y1 + y2) / 2 / 1200 + (y2 - y1) / 1200 / 2) * 640, 4) as y2 from r where rn <= 4""",
    "raw_scores_best": f"""{_SCORED}, b as (select image_id, det_id, x1, y1, x2, y2, list_max(scores) as conf, cast(list_position(scores, list_max(scores)) - 1 as int) as cls from raw), f as (select * from b where conf > 0.6)
      select image_id, det_id, cls, round(conf, 6) as conf from f p where not exists (select 1 from f q where q.image_id = p.image_id and q.cls = p.cls and (q.conf > p.conf or (q.conf = p.conf and q.det_id < p.det_id)) and {eq.NMS_IOU} >= 0.5)""",
    "raw_scores_every": f"{_SCORED} select image_id, det_id, cast(c as int) as cls, round(scores[c + 1], 6) as conf from raw, range(0, 6) t(c) where scores[c + 1] > 0.9",
    "prompt_points": f"""{_PG}, pt as (select image_id, gt_id as place, (x1 + x2) / 2 as x, (y1 + y2) / 2 as y, cast(pk % 3 > 0 as int) as label from gt), l as (select p.image_id, p.det_id, arg_max(label, place) as label from pred p join pt on p.image_id = pt.image_id and x >= x1 and x < x2 and y >= y1 and y < y2 group by 1, 2),
      k as (select image_id, max(label) = 0 as negative from pt group by 1) select image_id, det_id from pred join k using (image_id) left join l using (image_id, det_id) where case when label is null then negative else label = 1 end""",
    "eval_obb_ap": f"{_PG}, {eq.AP.replace(eq.PAIRS, _OBB)} select cls, thr, round(ap, 5) as ap from ap",
    "eval_segment_metrics": f"""with b as ({_PG}, {eq.AP} select round(avg(ap) filter (where thr = 0.5), 6) as box_map50, round(avg(ap), 6) as box_map, avg(ap) as raw_b from ap), m as ({_PG}, {eq.AP.replace(eq.PAIRS, _MASK)} select round(avg(ap) filter (where thr = 0.5), 6) as mask_map50, round(avg(ap), 6) as mask_map, avg(ap) as raw_m from ap)
      select box_map50, box_map, mask_map50, mask_map, round(raw_b + raw_m, 6) as fitness from b, m""",
    "eval_pose_matches": f"{_PG}, {eq.MATCH.replace(eq.PAIRS, _OKS).replace(eq.THR, 'thr as (select unnest([0.5::double, 0.75::double, 0.9::double]) as thr)')} select thr, image_id, det_id, gt_id from m",
    "eval_frequency_groups": f"""{ctes("images", "pred", "gt")}, {eq.AP}, fc as (select cls, count(distinct image_id) as n from gt group by 1), i as (select count(*) as n from images)
      select case when fc.n <= round_even(i.n * 0.40::double, 0) then 'rare' when fc.n <= round_even(i.n * 0.44::double, 0) then 'common' else 'frequent' end as band, count(distinct cls) as classes, round(avg(ap), 6) as ap from ap join fc using (cls), i group by 1""",
    "image_counts": f"{_G} select count(*) as instances, count(distinct image_id) as images from gt",
    "epoch_mask": f"{_I}, r as (select image_id, row_number() over (order by {_HASH.format('7:2:10')}, image_id) as rank, count(*) over () as n from images) select image_id, rank <= round_even(n * 0.3::double, 0) as chosen from r",
    "grouped_order": f"""{_I}, o as (select image_id, (row_number() over (order by image_id) - 1) // 4 as unit from images), p as (select image_id, unit, unnest(range(0, image_id % 3 + 1)) as k from o),
      h as (select *, md5(concat(cast(unit as varchar), ':5:0')) as hu, md5(concat(cast(image_id as varchar), ':5:0')) as hi from p)
      select image_id, cast(k as int) as k, unit, row_number() over (order by hu, unit, k, hi, image_id) as rank from h""",
    "repeated_samples": f"{_I}, r as (select image_id, cast(e as int) as epoch from images, range(0, 3) t(e) where image_id % 7 = 0) select image_id, epoch, row_number() over (partition by epoch order by md5(concat(cast(image_id as varchar), ':9:', cast(epoch as varchar))), image_id) as rank from r",
    "sample_counted": f"""{_I}, r as (select image_id, row_number() over (order by {_HASH.format('3')}, image_id) as rank, count(*) over () as n from images)
      select image_id, 'count' as tag from r where rank <= 17 union all select image_id, 'ratio' from r where rank <= greatest(1, round_even(n * 0.01::double, 0)) union all select image_id, 'least' from r where rank <= 1""",
    "collated": f"{ctes('images', 'gt')}, r as (select image_id, row_number() over (order by image_id) - 1 as r from images) select r // 32 as batch, cast(r % 32 as int) as batch_idx, image_id, gt_id, cls from gt join r using (image_id)",
    "mosaic9_labels": f"""{ctes("images", "gt")}, r as (select image_id, row_number() over (order by image_id) - 1 as r from images), p as (select image_id, r // 9 as canvas, cast(r % 9 as int) as cell from r),
      o as (select *, case cell when 0 then 640.0 when 1 then 640.0 when 2 then 640.0 + 1200 when 3 then 640.0 + 1200 when 4 then 640.0 + 1200 when 5 then 640.0 + 1200 - 1200 when 6 then 640.0 + 1200 - 1200 - 1200 when 7 then 640.0 - 1200 else 640.0 - 1200 end as dx,
        case cell when 0 then 640.0 when 1 then 640.0 - 900 when 2 then 640.0 - 900 when 3 then 640.0 when 4 then 640.0 + 900 when 5 then 640.0 + 900 when 6 then 640.0 + 900 when 7 then 640.0 + 900 - 900 else 640.0 + 900 - 900 - 900 end as dy from p),
      b as (select canvas, image_id, gt_id, cls, least(1280.0, greatest(0.0, x1 + dx - 320)) as x1, least(1280.0, greatest(0.0, y1 + dy - 320)) as y1, least(1280.0, greatest(0.0, x2 + dx - 320)) as x2, least(1280.0, greatest(0.0, y2 + dy - 320)) as y2 from gt join o using (image_id)) select * from b where x2 > x1 and y2 > y1""",
    "track_speed_steps": f"{ctes('points')}, f as (select frame, min(track_id) as first from points group by 1) select p.track_id, p.frame, round(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) / 10, 6) as distance from points p join f using (frame) join points q on q.frame = p.frame and q.track_id = f.first where p.track_id <> f.first",
    "track_costs": f"""{_PG}, j as (select g.image_id, gt_id, det_id, conf, {eq.INTER.replace('p.', 'q.')} as inter, (q.x2 - q.x1) * (q.y2 - q.y1) as qa, (g.x2 - g.x1) * (g.y2 - g.y1) as ga, (least(g.y2, q.y2) - greatest(g.y1, q.y1)) / (greatest(g.y2, q.y2) - least(g.y1, q.y1) + 1e-9::double) as hi from gt g join pred q on g.image_id = q.image_id and g.x1 < q.x2 and g.x2 > q.x1 and g.y1 < q.y2 and g.y2 > q.y1),
      k as (select *, inter / (qa + ga - inter + 1e-7::double) as iou from j) select image_id, gt_id, det_id, round(least(1, greatest(0, 1 - least(1, greatest(0, hi)) * iou + 0.1::double * abs(0.8::double + (0.8::double - 0.7::double) - conf))), 6) as cost from k where iou > 0.1""",
    "track_looks": f"""{_PG}, {eq.PAIRS}, j as (select p.*, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as c from pairs p left join embeddings a on a.vec_id = (det_id * 13 + p.image_id) % 500 left join embeddings b on b.vec_id = (gt_id * 13 + p.image_id) % 500 where iou > 0.3), k as (select *, greatest(0, (1 - c) / 2) as looks from j)
      select image_id, det_id, gt_id, round(least(1 - iou, case when iou >= 0.5 and looks <= 1 - 0.55::double then looks else 1.0 end), 5) as cost, round(1 - iou * conf, 6) as fused from k""",
    "text_prompts": f"""{_G}, own as (select distinct image_id, cls from gt), o as (select *, row_number() over (partition by image_id order by md5(concat_ws(':', cast(image_id as varchar), cast(cls as varchar), '11'))) as r from own), ch as (select * from o where r <= 4), m as (select image_id, count(*) as m from ch group by 1),
      ne as (select i.image_id, c.cls, row_number() over (partition by i.image_id order by md5(concat_ws(':', cast(i.image_id as varchar), cast(c.cls as varchar), '11'))) as r from m i, (select cast(unnest(range(0, 6)) as int) as cls) c where not exists (select 1 from own w where w.image_id = i.image_id and w.cls = c.cls)),
      al as (select image_id, cls, r from ch union all select ne.image_id, cls, 100 + r from ne join m using (image_id) where r <= least(2, 4 - m)), g as (select image_id, string_agg(cls, ',' order by r) as classes, string_agg('class' || cls, ',' order by r) as texts, count(*) as n from al group by 1)
      select image_id, classes, texts || repeat(',', cast(4 - n as int)) as texts from g""",
}
