"""Evaluation over the canonical boxes, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import evaluation as ev
from tessera.operators import suppress

from .canonical import CLASSES, ctes, read, table

T = lambda s, d, *names: [table(s, d, n) for n in names]

INTER = "greatest(0, least(p.x2, g.x2) - greatest(p.x1, g.x1)) * greatest(0, least(p.y2, g.y2) - greatest(p.y1, g.y1))"
PAIRS = f"""pairs as (select *, inter / (pa + ga - inter + 1e-7::double) as iou from (
  select p.image_id, p.det_id, p.conf, g.gt_id, p.cls as det_cls, g.cls as gt_cls, {INTER} as inter,
    (p.x2 - p.x1) * (p.y2 - p.y1) as pa, (g.x2 - g.x1) * (g.y2 - g.y1) as ga
  from pred p join gt g on p.image_id = g.image_id and g.x1 < p.x2 and g.x2 > p.x1 and g.y1 < p.y2 and g.y2 > p.y1))"""
THR = "thr as (select unnest([" + ", ".join(f"{t}::double" for t in ev.THRESHOLDS) + "]) as thr)"
MATCH = f"""{PAIRS}, {THR}, c as (
  select thr, p.*, row_number() over (partition by thr, image_id, det_id order by iou desc, gt_id) as rn1 from pairs p, thr where det_cls = gt_cls and iou >= thr
), m as (
  select thr, image_id, det_id, gt_id from (
    select *, row_number() over (partition by thr, image_id, gt_id order by conf desc, det_id) as rn2 from c where rn1 = 1) where rn2 = 1
)"""
CURVE = f"""{MATCH}, e as (
  select thr, p.cls, p.image_id, p.det_id, p.conf, case when m.gt_id is null then 0 else 1 end as tp
  from pred p cross join thr left join m using (thr, image_id, det_id)
), curve as (
  select *, sum(tp) over w as cum_tp, sum(1 - tp) over w as cum_fp, row_number() over w as n
  from e window w as (partition by thr, cls order by conf desc, image_id, det_id rows unbounded preceding)
), nl as (select cls, count(*) as n_labels from gt group by cls)"""
AP = f"""{CURVE}, pr as (
  select thr, cls, n, cum_tp / (n_labels + 1e-16::double) as recall, cum_tp / (cum_tp + cum_fp)::double as precision from curve join nl using (cls)
), tail as (select thr, cls, max(recall) as recall, max(n) as n from pr group by thr, cls), pts as (
  select thr, cls, 0 as n, 0.0::double as recall, 1.0::double as precision from tail union all select * from pr
  union all select thr, cls, n + 1, recall, 0.0 from tail union all select thr, cls, n + 2, 1.0, 0.0 from tail
), env as (
  select *, max(precision) over (partition by thr, cls order by n rows between current row and unbounded following) as v from pts
), steps as (
  select *, lead(recall) over w as r2, lead(v) over w as v2 from env window w as (partition by thr, cls order by n)
), grid as (select k, k / 100.0::double as x from range(0, 101) t(k)), hit as (
  select thr, cls, k, x, arg_max(s, n) as s from steps s join grid on recall <= x group by thr, cls, k, x
), y as (
  select thr, cls, k, case when s.r2 is null or s.recall = x then s.v when s.r2 = s.recall then s.v else s.v + (s.v2 - s.v) / (s.r2 - s.recall) * (x - s.recall) end as y from hit
), ap as (
  select nl.cls, thr.thr, coalesce((select sum(y * case when k in (0, 100) then 0.005 else 0.01 end) from y where y.cls = nl.cls and y.thr = thr.thr), 0.0) as ap from nl cross join thr
)"""


def _points(s, d):
    pred, gt = T(s, d, "pred", "gt")
    return pred, gt, ev.ranked_curve(ev.ranked(*(table(s, d, n, dealt=True) for n in ("pred", "gt"))))


def eval_matches(s, d):
    return ev.match(*T(s, d, "pred", "gt"))


def eval_ap_by_class(s, d):
    _, gt, points = _points(s, d)
    return ev.rounded(ev.average_precision(points, gt), "ap")


def eval_map(s, d):
    _, gt, points = _points(s, d)
    return ev.rounded(ev.mean_metrics(ev.average_precision(points, gt)), "map50", "map75", "map50_95")


def eval_curve_counts(s, d):
    _, _, points = _points(s, d)
    total, top = (lambda f: lambda tp, fp: f(tp)), (lambda f: lambda tp, fp: f(fp))
    return ev.by_threshold(points, ev.THRESHOLDS, sum_tp=total(F.sum), sum_fp=top(F.sum), tp=total(F.max), fp=top(F.max))


def eval_confidence_curves(s, d):
    _, gt, points = _points(s, d)
    return ev.rounded(ev.confidence_curves(points, gt), "p", "r", "f1")


def eval_best_f1(s, d):
    """Precision, recall and F1 of each class where the smoothed mean F1 is greatest."""
    _, gt, points = _points(s, d)
    curves = ev.confidence_curves(points, gt)
    mean = ev.smooth(curves.groupBy("k").agg(F.avg("f1").alias("f1")), "k", "f1", 1000, 0.1, "smooth")
    best = mean.agg(F.max_by("k", F.struct(F.round("smooth", 9), -F.col("k"))).alias("k"))
    return ev.rounded(curves.join(F.broadcast(best), "k").select("cls", "k", "p", "r", "f1"), "p", "r", "f1")


def eval_per_image(s, d):
    images, pred, gt = T(s, d, "images", "pred", "gt")
    return ev.rounded(ev.per_image(images, pred, gt, ev.match(pred, gt)), "precision", "recall", "f1")


def eval_confusion(s, d):
    return ev.confusion(*T(s, d, "pred", "gt"), CLASSES)


def eval_confusion_summary(s, d):
    return ev.from_confusion(ev.confusion(*T(s, d, "pred", "gt"), CLASSES), CLASSES)


def eval_class_summary(s, d):
    """Images, instances and AP of each class."""
    _, gt, points = _points(s, d)
    ap = ev.average_precision(points, gt)
    ap = ap.groupBy("cls").agg(F.round(F.max(F.when(F.col("thr") == 0.5, F.col("ap"))), 6).alias("ap50"), F.round(F.avg("ap"), 6).alias("ap"))
    return gt.groupBy("cls").agg(F.countDistinct("image_id").alias("images"), F.count(F.lit(1)).alias("instances")).join(ap, "cls")


def eval_area_buckets(s, d):
    """Recall at IoU 0.5 by label size."""
    pred, gt = T(s, d, "pred", "gt")
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    size = F.when(area < 32 * 32, "small").when(area < 96 * 96, "medium").otherwise("large")
    hit = ev.match(pred, gt, [0.5]).select("image_id", "gt_id", F.lit(1).alias("hit"))
    rows = gt.select("image_id", "gt_id", size.alias("size")).join(hit, ["image_id", "gt_id"], "left")
    return rows.groupBy("size").agg(F.count(F.lit(1)).alias("labels"), F.count("hit").alias("found"))


def classify_confusion(s, d):
    """Documents longer than 500 characters taken as good, against their quality labels."""
    rows = read(s, d, "labels").join(read(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.groupBy((F.col("n_chars") > 500).cast("int").alias("pred"), F.col("quality").alias("gt")).agg(F.count(F.lit(1)).alias("n"))


def _ranked(s, d):
    """Six classes ranked by falling pseudo-score for each image; its first label is the target."""
    gt = table(s, d, "gt").where("gt_id = 1")
    score = lambda c: (F.col("pk") * 31 + c * 17) % 101 * 10 + c
    ranked = F.transform(F.sort_array(F.array(*[F.struct(score(F.lit(c)).alias("s"), F.lit(c).alias("c")) for c in range(CLASSES)]), asc=False), lambda x: x["c"])
    return gt.select("image_id", "cls", ranked.alias("ranked"))


def classify_top5(s, d):
    return ev.rounded(ev.top_k_accuracy(_ranked(s, d), "cls", "ranked"), "top1", "top5")


def semantic_miou(s, d):
    px = table(s, d, "gt").select(F.when(F.col("pk") % 50 == 0, 255).otherwise(F.col("cls")).alias("target"), F.when(F.col("pk") % 7 == 0, (F.col("cls") + 1) % CLASSES).otherwise(F.col("cls")).alias("pred"))
    return ev.rounded(ev.semantic(px), "miou", "pixel_accuracy")


def depth_errors(s, d):
    px = read(s, d, "events").select((F.col("user_id") % 16).alias("image_id"), (F.col("value") + 1).alias("target"), (F.col("value") * 1.1 + F.col("event_id") % 7 * 0.2 + 0.5).alias("pred"))
    return ev.rounded(ev.depth_metrics(px), "delta1", "delta2", "delta3", "abs_rel", "rmse", "silog", places=5)


def iou_pairs(s, d):
    return ev.rounded(ev.pairs(*T(s, d, "pred", "gt"), same_class=False).select("image_id", "det_id", "gt_id", "iou"), "iou")


def nms_fast(s, d):
    return suppress.fast_nms(table(s, d, "pred"), 0.5).select("image_id", "det_id")


def nms_greedy(s, d):
    return suppress.greedy_nms(table(s, d, "pred"), 0.45).select("image_id", "det_id")


def nms_end_to_end(s, d):
    return suppress.end_to_end(table(s, d, "pred"), 0.25, [0, 1, 2], 3).select("image_id", "det_id", "conf")


def max_det(s, d):
    return suppress.top_by_confidence(table(s, d, "pred"), 2).select("image_id", "det_id")


BOX = "struct_pack(id := det_id, cls := cls, x1 := x1, y1 := y1, x2 := x2, y2 := y2)"
LOW = "greatest(0, least(p.x2, q.x2) - greatest(p.x1, q.x1)) * greatest(0, least(p.y2, q.y2) - greatest(p.y1, q.y1))"
NMS_IOU = LOW + " / ((p.x2 - p.x1) * (p.y2 - p.y1) + (q.x2 - q.x1) * (q.y2 - q.y1) - " + LOW + ")"
P6 = "round({0}, 6)".format

QUERIES = {f.__name__: f for f in (eval_matches, eval_ap_by_class, eval_map, eval_curve_counts, eval_confidence_curves, eval_best_f1, eval_per_image, eval_confusion, eval_confusion_summary, eval_class_summary, eval_area_buckets, classify_confusion, classify_top5, semantic_miou, depth_errors, iou_pairs, nms_fast, nms_greedy, nms_end_to_end, max_det)}

_PG = ctes("pred", "gt")
_CONF = f"""{_PG}, {PAIRS}, c as (
  select *, row_number() over (partition by image_id, det_id order by iou desc, gt_id) as rn1 from pairs where conf > 0.25 and iou > 0.45
), m as (
  select * from (select *, row_number() over (partition by image_id, gt_id order by iou desc, det_id) as rn2 from c where rn1 = 1) where rn2 = 1
), cells as (
  select det_cls as pred, gt_cls as gt from m
  union all select cls, 6 from pred p where conf > 0.25 and not exists (select 1 from m where m.image_id = p.image_id and m.det_id = p.det_id)
  union all select 6, cls from gt g where not exists (select 1 from m where m.image_id = g.image_id and m.gt_id = g.gt_id)
), matrix as (select pred, gt, count(*) as n from cells group by 1, 2)"""
_GRID = f"""{_PG}, {CURVE}, a as (
  select cls, conf, n, cum_tp / (n_labels + 1e-16::double) as r, cum_tp / (cum_tp + cum_fp)::double as p from curve join nl using (cls) where thr = 0.5
), l as (select cls, conf, min_by(r, n) as r1, min_by(p, n) as p1, max_by(r, n) as r2, max_by(p, n) as p2 from a group by cls, conf),
ends as (select cls, max(conf) as top, min(conf) as bottom, max_by(r, n) as lr, max_by(p, n) as lp from a group by cls),
g as (select cls, k, k / 999.0::double as x, top, bottom, lr, lp from ends, range(0, 1000) t(k)),
b as (select g.*, arg_max(l, l.conf) as lo from g left join l on l.cls = g.cls and l.conf <= g.x group by all),
u as (select b.*, arg_min(l, l.conf) as hi from b left join l on l.cls = b.cls and l.conf > b.x group by all),
pr as (select cls, k,
  case when x > top then 1.0 when x < bottom then lp when x = lo.conf or hi is null then lo.p1 else lo.p1 + (hi.p2 - lo.p1) * ((x - lo.conf) / (hi.conf - lo.conf)) end as p,
  case when x > top then 0.0 when x < bottom then lr when x = lo.conf or hi is null then lo.r1 else lo.r1 + (hi.r2 - lo.r1) * ((x - lo.conf) / (hi.conf - lo.conf)) end as r from u),
f as (select *, 2 * p * r / (p + r + 1e-16::double) as f1 from pr)"""

SQL = {
    "eval_matches": f"{_PG}, {MATCH} select thr, image_id, det_id, gt_id from m",
    "eval_ap_by_class": f"{_PG}, {AP} select cls, thr, round(ap, 6) as ap from ap",
    "eval_map": f"{_PG}, {AP} select round(avg(ap) filter (where thr = 0.5), 6) as map50, round(avg(ap) filter (where thr = 0.75), 6) as map75, round(avg(ap), 6) as map50_95 from ap",
    "eval_curve_counts": f"{_PG}, {CURVE} select thr, cls, cast(sum(cum_tp) as bigint) as sum_tp, cast(sum(cum_fp) as bigint) as sum_fp, cast(max(cum_tp) as bigint) as tp, cast(max(cum_fp) as bigint) as fp from curve group by thr, cls",
    "eval_confidence_curves": f"{_GRID} select cls, k, round(p, 6) as p, round(r, 6) as r, round(f1, 6) as f1 from f",
    "eval_best_f1": f"""{_GRID}, mf as (select k, avg(f1) as f1 from f group by k),
      sm as (select k, (sum(f1) over (order by k rows between 50 preceding and 50 following) + greatest(0, 50 - k) * first_value(f1) over (order by k rows between unbounded preceding and unbounded following)
        + greatest(0, k + 50 - 999) * last_value(f1) over (order by k rows between unbounded preceding and unbounded following)) / 101 as s from mf)
      select cls, k, round(p, 6) as p, round(r, 6) as r, round(f1, 6) as f1 from f where k = (select k from sm order by round(s, 9) desc, k limit 1)""",
    "eval_per_image": f"""{ctes("images", "pred", "gt")}, {MATCH}, n as (
        select i.image_id, (select count(*) from pred p where p.image_id = i.image_id) as n_pred, (select count(*) from gt g where g.image_id = i.image_id) as n_gt,
          (select count(*) from m where m.image_id = i.image_id and thr = 0.5) as tp from images i
      ), r as (select *, case when n_pred = 0 and n_gt = 0 then 1.0 when n_pred > 0 then tp / n_pred::double else 0.0 end as precision, case when n_pred = 0 and n_gt = 0 then 1.0 when n_gt > 0 then tp / n_gt::double else 0.0 end as recall from n)
      select image_id, tp, n_pred - tp as fp, n_gt - tp as fn, round(precision, 6) as precision, round(recall, 6) as recall, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 6) as f1 from r""",
    "eval_confusion": f"{_CONF} select * from matrix",
    "eval_confusion_summary": f"""{_CONF} select c as cls, cast(coalesce(sum(n) filter (where pred = c and gt = c), 0) as bigint) as tp, cast(coalesce(sum(n) filter (where pred = c and gt <> c), 0) as bigint) as fp,
      cast(coalesce(sum(n) filter (where gt = c and pred <> c), 0) as bigint) as fn from range(0, 6) t(c), matrix group by c""",
    "eval_class_summary": f"""{_PG}, {AP}, a as (select cls, round(max(ap) filter (where thr = 0.5), 6) as ap50, round(avg(ap), 6) as ap from ap group by cls)
      select cls, images, instances, ap50, ap from (select cls, count(distinct image_id) as images, count(*) as instances from gt group by cls) join a using (cls)""",
    "eval_area_buckets": f"""{_PG}, {MATCH} select case when a < 1024 then 'small' when a < 9216 then 'medium' else 'large' end as size, count(*) as labels, count(m.det_id) as found
      from (select *, (x2 - x1) * (y2 - y1) as a from gt) g left join (select * from m where thr = 0.5) m using (image_id, gt_id) group by 1""",
    "classify_confusion": "select cast(n_chars > 500 as int) as pred, quality as gt, count(*) as n from labels join documents using (doc_id) group by 1, 2",
    "classify_top5": f"""{ctes("gt")}, r as (select image_id, cls, c, row_number() over (partition by image_id order by (pk * 31 + c * 17) % 101 * 10 + c desc) as rk from gt, range(0, 6) t(c) where gt_id = 1)
      select round(avg(cast(rk = 1 as double)), 6) as top1, round(avg(cast(rk <= 5 as double)), 6) as top5 from r where c = cls""",
    "semantic_miou": f"""{ctes("gt")}, px as (select case when pk % 50 = 0 then 255 else cls end as t, case when pk % 7 = 0 then (cls + 1) % 6 else cls end as p from gt), ok as (select * from px where t <> 255),
      c as (select t as cls, count(*) as n, count(*) filter (where t = p) as tp, (select count(*) from ok o where o.p = ok.t) as cols from ok group by t)
      select round(avg(tp / (n + cols - tp)::double), 6) as miou, round(sum(tp) / sum(n)::double, 6) as pixel_accuracy from c""",
    "depth_errors": """with px as (select user_id % 16 as image_id, value + 1 as target, value * 1.1::double + event_id % 7 * 0.2::double + 0.5 as pred from events), ok as (select * from px where target > 0 and pred > 0),
      sc as (select image_id, quantile_disc(target, 0.5) as mt, quantile_disc(pred, 0.5) as mp from ok group by image_id having count(*) >= 10),
      r as (select image_id, target, pred * mt / mp as p from ok join sc using (image_id)), q as (select *, greatest(p / target, target / p) as ratio, ln(p) - ln(target) as lg from r),
      i as (select image_id, avg(cast(ratio < 1.25 as double)) as delta1, avg(cast(ratio < 1.5625 as double)) as delta2, avg(cast(ratio < 1.953125 as double)) as delta3, avg(abs(p - target) / target) as abs_rel,
        sqrt(avg((p - target) * (p - target))) as rmse, sqrt(greatest(0, avg(lg * lg) - avg(lg) * avg(lg))) * 100 as silog from q group by image_id)
      select round(avg(delta1), 5) as delta1, round(avg(delta2), 5) as delta2, round(avg(delta3), 5) as delta3, round(avg(abs_rel), 5) as abs_rel, round(avg(rmse), 5) as rmse, round(avg(silog), 5) as silog from i""",
    "iou_pairs": f"{_PG}, {PAIRS} select image_id, det_id, gt_id, round(iou, 6) as iou from pairs",
    "nms_fast": f"{ctes('pred')} select image_id, det_id from pred p where not exists (select 1 from pred q where q.image_id = p.image_id and q.cls = p.cls and (q.conf > p.conf or (q.conf = p.conf and q.det_id < p.det_id)) and {NMS_IOU} >= 0.5)",
    "nms_greedy": f"""{ctes("pred").replace("with ", "with recursive ")}, o as (select *, row_number() over (partition by image_id, cls order by conf desc, det_id) as rk from pred),
      k as (
        select image_id, cls, 1::bigint as rk, [{BOX}] as kept from o where rk = 1
        union all
        select p.image_id, p.cls, p.rk, case when len(list_filter(k.kept, lambda q: {NMS_IOU} > 0.45)) = 0 then list_append(k.kept, {BOX.replace(":= ", ":= p.")}) else k.kept end
        from k join o p on p.image_id = k.image_id and p.cls = k.cls and p.rk = k.rk + 1
      ), last as (select image_id, cls, max_by(kept, rk) as kept from k group by 1, 2)
      select image_id, unnest(kept).id as det_id from last""",
    "nms_end_to_end": f"{ctes('pred')} select image_id, det_id, conf from (select *, row_number() over (partition by image_id order by det_id) as rn from pred where conf > 0.25 and cls in (0, 1, 2)) where rn <= 3",
    "max_det": f"{ctes('pred')} select image_id, det_id from (select *, row_number() over (partition by image_id order by conf desc, det_id) as rn from pred) where rn <= 2",
}
