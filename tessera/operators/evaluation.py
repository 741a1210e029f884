"""Detection evaluation: matching predictions to ground truth, precision, recall, average precision, confusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.boxes import area, cols, iou, overlaps, prob_iou
from tessera.functions.kernels import group_slices, whole_groups
from tessera.storage import settled, written

from .scans import parts_for, running_sums, tasks_for

THRESHOLDS = [round(0.5 + 0.05 * i, 2) for i in range(10)]
EPS = 1e-16


def beside(p: DataFrame, g: DataFrame, image: Column, near: Column, same_class: bool = True, every: bool = True) -> DataFrame:
    """Detections with the labels of their image that are near; with ``every``, detections without any have a row as well.

    For that the class is a range beside the image, not a second key: rows that are dealt out by image
    already need not be dealt out again.
    """
    det, label = F.col("det_cls"), F.col("gt_cls")
    if every:
        return p.join(g, image & (det.between(label, label) & near if same_class else near), "left")
    return p.join(g, image & (det == label) & near if same_class else image & near)


def pairs(pred: DataFrame, gt: DataFrame, same_class: bool = True, every: bool = False) -> DataFrame:
    """(image_id, det_id, conf, gt_id, iou, det_cls, gt_cls) of overlapping boxes of one image: an equi-join with a range predicate. ``every``: see :func:`beside`."""
    p = pred.select("image_id", "det_id", "conf", F.col("cls").alias("det_cls"), *[F.col(c).alias(f"p{c}") for c in ("x1", "y1", "x2", "y2")])
    g = gt.select("image_id", "gt_id", F.col("cls").alias("gt_cls"), *[F.col(c).alias(f"g{c}") for c in ("x1", "y1", "x2", "y2")])
    a, b = cols("gx1", "gy1", "gx2", "gy2"), cols("px1", "py1", "px2", "py2")
    return beside(p, g, p["image_id"] == g["image_id"], overlaps(a, b), same_class, every).select(p["image_id"], "det_id", "conf", "gt_id", iou(a, b).alias("iou"), "det_cls", "gt_cls")


def rotated_pairs(pred: DataFrame, gt: DataFrame, every: bool = False) -> DataFrame:
    """The pairs of rotated boxes (cx, cy, w, h, theta) of one image and class, scored by probabilistic IoU; boxes farther apart than their half diagonals score (almost) nothing and are left out."""
    five = ("cx", "cy", "w", "h", "theta")
    p = pred.select("image_id", "det_id", "conf", F.col("cls").alias("det_cls"), *[F.col(c).alias(f"p_{c}") for c in five])
    g = gt.select(F.col("image_id").alias("i_"), "gt_id", F.col("cls").alias("gt_cls"), *[F.col(c).alias(f"g_{c}") for c in five])
    reach = (F.hypot("p_w", "p_h") + F.hypot("g_w", "g_h")) / 2
    near = (F.abs(F.col("p_cx") - F.col("g_cx")) < reach) & (F.abs(F.col("p_cy") - F.col("g_cy")) < reach)
    score = prob_iou(tuple(F.col(f"g_{c}") for c in five), tuple(F.col(f"p_{c}") for c in five))
    return beside(p, g, F.col("image_id") == F.col("i_"), near, True, every).select("image_id", "det_id", "conf", "gt_id", score.alias("iou"), "det_cls", "gt_cls")


def keypoint_pairs(pred: DataFrame, gt: DataFrame, sigmas: list[float], area_share: float = 0.53) -> DataFrame:
    """The pairs of one image and class scored by the similarity of their key points (``kpts``: array of struct<x, y, v>), the label's visible ones."""
    from .spatial import keypoint_similarity

    p = pred.select("image_id", "det_id", "conf", F.col("cls").alias("det_cls"), F.col("kpts").alias("p_kpts"))
    g = gt.select(F.col("image_id").alias("i_"), "gt_id", F.col("cls").alias("gt_cls"), F.col("kpts").alias("g_kpts"), (area(cols("x1", "y1", "x2", "y2")) * area_share).alias("size"))
    score = keypoint_similarity(F.col("g_kpts"), F.col("p_kpts"), F.col("size"), sigmas)
    return p.join(g, (F.col("image_id") == F.col("i_")) & (F.col("det_cls") == F.col("gt_cls"))).select("image_id", "det_id", "conf", "gt_id", score.alias("iou"), "det_cls", "gt_cls")


def match(pred: DataFrame, gt: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """(thr, image_id, det_id, gt_id): true positives of boxes at each threshold."""
    return match_pairs(pairs(pred, gt), thresholds)


def match_pairs(scored: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """(thr, image_id, det_id, gt_id) from scored pairs (image_id, det_id, conf, gt_id, iou), whatever the score: boxes, rotated boxes, masks, key points.

    A detection's only candidate is its label of greatest score, which no threshold changes, so it is
    ranked once; each label then takes, at every threshold, its candidate of greatest confidence.
    """
    best = Window.partitionBy("image_id", "det_id").orderBy(F.desc("iou"), "gt_id")
    one = scored.where(F.col("iou") >= min(thresholds)).withColumn("rn", F.row_number().over(best)).where("rn = 1")
    met = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= F.col("iou"))
    first = Window.partitionBy("thr", "image_id", "gt_id").orderBy(F.desc("conf"), "det_id")
    return one.withColumn("thr", F.explode(met)).withColumn("rn", F.row_number().over(first)).where("rn = 1").select("thr", "image_id", "det_id", "gt_id")


def ranked(pred: DataFrame, gt: DataFrame, score: Callable[..., DataFrame] = pairs, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """(cls, conf, image_id, det_id, low, high), written, a row a detection: the true positives of :func:`match_pairs` at the thresholds from place ``low`` up to ``high``, excluded. ``thresholds`` rise.

    ``score(pred, gt, every=True)`` pairs them. A detection holds its candidate at a threshold that it
    reaches and no detection before it does. All is by image: one exchange serves pairs and windows.
    """
    place = F.col("image_id")
    scored = score(pred.where(place.isNotNull()), gt, every=True).withColumn("iou", F.when(F.col("gt_id").isNotNull(), F.col("iou")))
    best = F.max(F.struct(F.col("iou"), (-F.col("gt_id")).alias("label"))).alias("best")
    one = scored.groupBy("image_id", "det_id").agg(F.first("det_cls").alias("cls"), F.first("conf").alias("conf"), best).select("image_id", "det_id", "cls", "conf", "best.iou", "best.label")
    before = F.max("iou").over(Window.partitionBy("image_id", "label").orderBy(F.desc("conf"), "det_id").rowsBetween(Window.unboundedPreceding, -1))
    met = lambda c: sum((F.when(F.col(c) >= float(t), 1).otherwise(0) for t in thresholds), F.lit(0)).cast("byte")
    rows = one.withColumn("before", before).select("cls", "conf", "image_id", "det_id", F.least(met("before"), met("iou")).alias("low"), met("iou").alias("high"))
    none = F.lit(0).cast("byte")
    return written(rows.unionByName(pred.where(place.isNull()).select("cls", "conf", "image_id", "det_id", none.alias("low"), none.alias("high"))))


def by_frequency(ap: DataFrame, gt: DataFrame, rare: int = 10, common: int = 100) -> DataFrame:
    """(band, classes, ap): mean AP of the classes that at most ``rare`` images have, at most ``common``, and of the rest."""
    n = gt.groupBy("cls").agg(F.countDistinct("image_id").alias("n"))
    band = F.when(F.col("n") <= rare, "rare").when(F.col("n") <= common, "common").otherwise("frequent")
    return ap.join(F.broadcast(n), "cls").groupBy(band.alias("band")).agg(F.countDistinct("cls").alias("classes"), F.avg("ap").alias("ap"))


def match_any_class(pred: DataFrame, gt: DataFrame, least_iou: float = 0.45, least_conf: float = 0.25) -> DataFrame:
    """(image_id, det_id, gt_id, det_cls, gt_cls): one-to-one, by IoU in both steps, strictly above both limits."""
    by_det = Window.partitionBy("image_id", "det_id").orderBy(F.desc("iou"), "gt_id")
    by_gt = Window.partitionBy("image_id", "gt_id").orderBy(F.desc("iou"), "det_id")
    found = pairs(pred.where(F.col("conf") > least_conf), gt, same_class=False).where(F.col("iou") > least_iou)
    found = found.withColumn("rn", F.row_number().over(by_det)).where("rn = 1")
    return found.withColumn("rn", F.row_number().over(by_gt)).where("rn = 1").drop("rn", "iou", "conf")


def confusion(pred: DataFrame, gt: DataFrame, classes: int, least_iou: float = 0.45, least_conf: float = 0.25) -> DataFrame:
    """(pred, gt, n): ``classes`` stands for background on either side."""
    m = match_any_class(pred, gt, least_iou, least_conf)
    lone_p = pred.where(F.col("conf") > least_conf).join(m, ["image_id", "det_id"], "left_anti").select(F.col("cls").alias("pred"), F.lit(classes).alias("gt"))
    lone_g = gt.join(m, ["image_id", "gt_id"], "left_anti").select(F.lit(classes).alias("pred"), F.col("cls").alias("gt"))
    return m.select(F.col("det_cls").alias("pred"), F.col("gt_cls").alias("gt")).unionAll(lone_p).unionAll(lone_g).groupBy("pred", "gt").agg(F.count(F.lit(1)).alias("n"))


def curve(pred: DataFrame, matches: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """(cls, conf, bucket, hit, n, c0, c1, ..): predictions of each class by falling confidence, ties by image and detection.

    ``n`` counts them; ``c<i>`` counts the true positives at threshold i so far; ``hit`` lists the
    thresholds at which the row itself is one. One row a prediction, whatever the number of thresholds.
    """
    hits = matches.groupBy("image_id", "det_id").agg(F.collect_set("thr").alias("hit"))
    rows = pred.select("image_id", "det_id", "cls", "conf").join(hits, ["image_id", "det_id"], "left").withColumn("hit", F.coalesce("hit", F.array().cast("array<double>")))
    return _counted(rows, pred.count(), [F.array_contains("hit", float(t)) for t in thresholds])


def ranked_curve(rows: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """:func:`curve` of rows from :func:`ranked`, which are narrow: they are what is sorted."""
    out = _counted(rows, rows.count(), [(F.col("low") <= i) & (F.col("high") > i) for i in range(len(thresholds))])
    return out.withColumn("hit", F.slice(F.array(*[F.lit(float(t)) for t in thresholds]), F.col("low") + 1, F.col("high") - F.col("low"))).drop("low", "high")


def _counted(rows: DataFrame, size: int, flags: list[Column]) -> DataFrame:
    rows = rows.withColumn("bucket", (-F.floor(F.col("conf") * parts_for(size))).cast("long"))
    order = [F.desc("conf"), F.col("image_id"), F.col("det_id")]
    return running_sums(rows, ["cls"], "bucket", order, {"n": F.lit(1)} | {f"c{i}": f.cast("int") for i, f in enumerate(flags)}, tasks_for(rows.sparkSession, size))


def counts_at(points: DataFrame, i: int) -> DataFrame:
    """(cls, conf, cum_tp, cum_fp) of :func:`curve` at threshold i."""
    return points.select("cls", "conf", F.col(f"c{i}").alias("cum_tp"), (F.col("n") - F.col(f"c{i}")).alias("cum_fp"))


def by_threshold(points: DataFrame, thresholds: list[float], **aggregates: Callable[[Column, Column], Column]) -> DataFrame:
    """(thr, cls, ..): aggregates of (cum_tp, cum_fp) for each class and threshold, from one pass."""
    made = [F.struct(F.lit(float(t)).alias("thr"), *[f(F.col(f"c{i}"), F.col("n") - F.col(f"c{i}")).alias(k) for k, f in aggregates.items()]) for i, t in enumerate(thresholds)]
    return points.groupBy("cls").agg(F.array(*made).alias("a")).select("cls", F.explode("a").alias("a")).select("a.thr", "cls", *[f"a.{k}" for k in aggregates])


def average_precision(points: DataFrame, gt: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """(cls, thr, ap) for every class with labels, from :func:`curve`: 101-point interpolation of the precision envelope.

    Recall grows at true positives only and precision is greatest there, so only these rows count.
    Between two of them the envelope is linear; a row emits the grid points up to the next one. Which
    rows emit any follows from their number, 101 at most for each class and threshold; these, and the
    runs of rows between them, are one aggregate each, so nothing is dealt out or sorted again.
    """
    counted = settled(gt.groupBy("cls").agg(F.count(F.lit(1)).alias("n_labels")).coalesce(1))  # a row a class
    labels = F.broadcast(counted)
    hit = F.array_compact(F.array(*[F.when(F.array_contains("hit", float(t)), F.struct(F.lit(float(t)).alias("thr"), F.col(f"c{i}").alias("cum_tp"))) for i, t in enumerate(thresholds)]))
    hits = points.where(F.size("hit") > 0).select("cls", "n", F.explode(hit).alias("h")).select("h.*", "cls", "n").join(labels, "cls")
    step = lambda c: first_step(c / (F.col("n_labels") + EPS), 100.0)
    low, high = step(F.col("cum_tp")), step(F.col("cum_tp") + 1) - 1
    hits = hits.withColumns({"low": low, "high": high, "top": F.col("cum_tp") / F.col("n")}).withColumn("high", F.when(F.col("low") <= F.col("high"), F.col("high")))
    runs = hits.groupBy("thr", "cls", "n_labels", "low", "high").agg(F.min("n").alias("n"), F.min("cum_tp").alias("cum_tp"), F.max("top").alias("top"))
    zero = F.lit(0).cast("long")
    start = labels.select(F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("thr"), "cls", "n_labels", zero.alias("n"), zero.alias("cum_tp"), F.lit(1.0).alias("top"))
    runs = runs.unionByName(start.withColumns({"low": low, "high": high}))
    from_end = Window.partitionBy("thr", "cls").orderBy(F.desc("cum_tp")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.withColumns({"env": F.max("top").over(from_end), "recall": F.col("cum_tp") / (F.col("n_labels") + EPS)})
    after = Window.partitionBy("thr", "cls").orderBy(F.desc("cum_tp"))
    steps = runs.withColumns({f"next_{c}": F.lag(c).over(after) for c in ("n", "recall", "env")}).where("low <= high and next_n is not null")
    # the envelope just after this recall: its own value, or that of the next hit where misses lie between
    here = F.when(F.col("next_n") - F.col("n") > 1, F.col("next_env")).otherwise(F.col("env"))
    grid = steps.withColumn("here", here).withColumn("k", F.explode(F.sequence("low", "high")))
    x = F.col("k") / 100.0
    value = F.col("here") + (F.col("next_env") - F.col("here")) / (F.col("next_recall") - F.col("recall")) * (x - F.col("recall"))
    weight = F.when(F.col("k").isin(0, 100), 0.005).otherwise(0.01)
    ap = grid.select("thr", "cls", "k", value.alias("y")).groupBy("thr", "cls").agg(F.sum(F.col("y") * weight).alias("ap"))
    every = labels.select("cls", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("thr"))
    return every.join(ap, ["cls", "thr"], "left").select("cls", "thr", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def first_step(x: Column, steps: float) -> Column:
    """The least whole k with ``k / steps >= x``, as floating point compares."""
    k = F.ceil(x * steps)
    return F.when((k - 1) / steps >= x, k - 1).when(k / steps < x, k + 1).otherwise(k)


def mean_metrics(ap: DataFrame) -> DataFrame:
    """map50, map75, map50_95 (also the fitness) over classes with labels."""
    at = lambda t: F.avg(F.when(F.abs(F.col("thr") - t) < 1e-9, F.col("ap")))
    return ap.agg(at(0.5).alias("map50"), at(0.75).alias("map75"), F.avg("ap").alias("map50_95"))


def confidence_curves(points: DataFrame, gt: DataFrame, steps: int = 1000) -> DataFrame:
    """(cls, k, p, r, f1) at ``k / (steps - 1)`` confidence, the first threshold (0.5), interpolated linearly between predictions.

    A grid point lies between the last prediction of at least its confidence and the next one; below
    the least confidence the last values hold, above the greatest recall is 0 and precision 1.
    """
    labels = gt.groupBy("cls").agg(F.count(F.lit(1)).alias("n_labels"))
    at50 = counts_at(points, 0).join(F.broadcast(labels), "cls").select("cls", "conf", (F.col("cum_tp") / (F.col("n_labels") + EPS)).alias("r"), (F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))).alias("p"), (F.col("cum_tp") + F.col("cum_fp")).alias("n"))
    # of equal confidences the interpolation reads the first on the way down and the last on the way up
    level = at50.groupBy("cls", "conf").agg(F.min_by(F.struct("r", "p"), "n").alias("first"), F.max_by(F.struct("r", "p"), "n").alias("last"))
    w = Window.partitionBy("cls").orderBy(F.desc("conf"))
    level = level.withColumns({"up": F.lag("conf").over(w), "up_last": F.lag("last").over(w)})
    top = float(steps - 1)
    x = F.col("k") / top
    low = first_step(F.col("conf"), top)
    high = F.when(F.col("up").isNull(), F.when(low / top == F.col("conf"), low).otherwise(low - 1)).otherwise(first_step(F.col("up"), top) - 1)
    grid = level.where(low <= high).withColumn("k", F.explode(F.sequence(low, high)))
    share = (x - F.col("conf")) / (F.col("up") - F.col("conf"))
    mix = lambda c: F.when(F.col("up").isNull() | (x == F.col("conf")), F.col(f"first.{c}")).otherwise(F.col(f"first.{c}") + (F.col(f"up_last.{c}") - F.col(f"first.{c}")) * share)
    inner = grid.select("cls", "k", mix("p").alias("p"), mix("r").alias("r"))
    ends = at50.groupBy("cls").agg(F.max("conf").alias("top"), F.min("conf").alias("bottom"), F.max_by(F.struct("r", "p"), "n").alias("last"))
    every = ends.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long"))))
    out = every.join(inner, ["cls", "k"], "left")
    value = lambda c, above: F.when(x > F.col("top"), above).when(x < F.col("bottom"), F.col(f"last.{c}")).otherwise(F.col(c))
    out = out.select("cls", "k", value("p", 1.0).alias("p"), value("r", 0.0).alias("r"))
    return out.withColumn("f1", 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r") + EPS))


def smooth(df: DataFrame, order: str, value: str, rows: int, fraction: float, name: str, keys: list[str] | None = None) -> DataFrame:
    """Box filter of odd width ``round(rows * fraction * 2) // 2 + 1`` (an even one grows by 1) with the ends repeated. ``order`` counts 0 to rows - 1."""
    half = (round(rows * fraction * 2) // 2 + 1) // 2
    w = Window.partitionBy(*(keys or [])).orderBy(order)
    around, whole = w.rowsBetween(-half, half), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    short_left, short_right = F.greatest(F.lit(0), half - F.col(order)), F.greatest(F.lit(0), F.col(order) + half - (rows - 1))
    total = F.sum(value).over(around) + short_left * F.first(value).over(whole) + short_right * F.last(value).over(whole)
    return df.withColumn(name, total / (2 * half + 1))


def per_image(images: DataFrame, pred: DataFrame, gt: DataFrame, matches: DataFrame, thr: float = 0.5) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of every image; an image without labels and predictions scores 1."""
    count = lambda df, name: df.groupBy("image_id").agg(F.count(F.lit(1)).alias(name))
    tp = count(matches.where(F.abs(F.col("thr") - thr) < 1e-9), "tp")
    rows = images.select("image_id").join(count(pred, "n_pred"), "image_id", "left").join(count(gt, "n_gt"), "image_id", "left").join(tp, "image_id", "left").fillna(0)
    rows = rows.withColumns({"fp": F.col("n_pred") - F.col("tp"), "fn": F.col("n_gt") - F.col("tp")})
    none = (F.col("n_pred") == 0) & (F.col("n_gt") == 0)
    ratio = lambda a, b: F.when(none, 1.0).when(b > 0, a / b).otherwise(0.0)
    rows = rows.withColumns({"precision": ratio(F.col("tp"), F.col("n_pred")), "recall": ratio(F.col("tp"), F.col("n_gt"))})
    both = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)).select("image_id", "tp", "fp", "fn", "precision", "recall", "f1")


def from_confusion(matrix: DataFrame, classes: int) -> DataFrame:
    """(cls, tp, fp, fn) of a confusion table without its background class."""
    tp = F.when(F.col("pred") == F.col("gt"), F.col("n")).otherwise(0)
    by_pred = matrix.where(F.col("pred") < classes).groupBy(F.col("pred").alias("cls")).agg(F.sum(tp).alias("tp"), F.sum(F.col("n") - tp).alias("fp"))
    by_gt = matrix.where(F.col("gt") < classes).groupBy(F.col("gt").alias("cls")).agg(F.sum(F.col("n") - tp).alias("fn"))
    return by_pred.join(by_gt, "cls", "full").fillna(0)


def semantic(pixels: DataFrame, ignore: int = 255) -> DataFrame:
    """(target, pred) rows → miou over classes in the ground truth, pixel_accuracy."""
    cells = pixels.where(F.col("target") != ignore).groupBy("target", "pred").agg(F.count(F.lit(1)).alias("n"))
    diag = F.when(F.col("target") == F.col("pred"), F.col("n")).otherwise(0)
    t = cells.groupBy(F.col("target").alias("cls")).agg(F.sum("n").alias("rows"), F.sum(diag).alias("tp"))
    p = cells.groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("columns"))
    joined = t.join(p, "cls", "left").fillna(0)
    return joined.agg(F.avg(F.col("tp") / (F.col("rows") + F.col("columns") - F.col("tp"))).alias("miou"), (F.sum("tp") / F.sum("rows")).alias("pixel_accuracy"))


def depth_metrics(pixels: DataFrame, least: int = 10) -> DataFrame:
    """(image_id, pred, target) depths → delta1..3, abs_rel, rmse, silog: per image after scaling by the ratio of lower medians, then the mean."""
    ok = pixels.where("target > 0 and pred > 0")
    lower = lambda c: F.expr(f"percentile_disc(0.5) within group (order by {c})")
    scale = ok.groupBy("image_id").agg(lower("target").alias("mt"), lower("pred").alias("mp"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    rows = ok.join(scale, "image_id").withColumn("p", F.col("pred") * F.col("mt") / F.col("mp"))
    ratio, log = F.greatest(F.col("p") / F.col("target"), F.col("target") / F.col("p")), F.log("p") - F.log("target")
    within = lambda k: F.avg((ratio < 1.25**k).cast("double"))
    image = rows.groupBy("image_id").agg(within(1).alias("delta1"), within(2).alias("delta2"), within(3).alias("delta3"), F.avg(F.abs(F.col("p") - F.col("target")) / F.col("target")).alias("abs_rel"), F.sqrt(F.avg((F.col("p") - F.col("target")) ** 2)).alias("rmse"), (F.sqrt(F.greatest(F.lit(0.0), F.avg(log * log) - F.avg(log) ** 2)) * 100).alias("silog"))
    return image.agg(*[F.avg(c).alias(c) for c in ("delta1", "delta2", "delta3", "abs_rel", "rmse", "silog")])


def top_k_accuracy(rows: DataFrame, target: str, ranked: str) -> DataFrame:
    """top1 and top5 of an array of classes by falling score."""
    hit = lambda k: F.avg(F.array_contains(F.slice(ranked, 1, k), F.col(target)).cast("double"))
    return rows.agg(hit(1).alias("top1"), hit(5).alias("top5"))


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def sigma_clip(rows: DataFrame, value: str, sigmas: float = 2.0, rounds: int = 3) -> DataFrame:
    """Rows whose ``value`` is within ``sigmas`` deviations of the mean, again and again: each round keeps a range, so only bounds are carried over."""
    low = high = None
    for _ in range(rounds):
        m, sd = rows.where(F.col(value).between(low, high) if low is not None else F.lit(True)).agg(F.avg(value), F.stddev_pop(value)).first()
        if m is None:
            return rows.limit(0)
        low, high = max(m - sigmas * sd, low if low is not None else float("-inf")), min(m + sigmas * sd, high if high is not None else float("inf"))
    return rows.where((F.col(value) >= low) & (F.col(value) <= high))


def confidence_band(conf: Column, high: float = 0.25, low: float = 0.1) -> Column:
    """high from ``high`` on, low strictly between the two, none below."""
    return F.when(conf >= high, "high").when((conf > low) & (conf < high), "low").otherwise("none")


#: Ranges of an object's area.
SIZES = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}


def sized_matches(det: np.ndarray, label: np.ndarray, score: np.ndarray, turn: np.ndarray, ignored: np.ndarray, thresholds: list[float]) -> np.ndarray:
    """Label that each detection takes, -1 for none, (thresholds, detections), from the scored pairs of many images and classes.

    Detections choose by ``turn`` (a number each, by falling confidence within their image and class) the
    free label of greatest score at each threshold, one that counts before one that is ignored. All
    detections of a turn choose at once, as they share no label.
    """
    out = np.full((len(thresholds), len(turn)), -1)
    order = np.lexsort((label, -score, ignored[label], det, turn[det]))
    det, label, score = det[order], label[order], score[order]
    ends = np.append(np.flatnonzero(np.diff(turn[det])) + 1, len(det))
    for t, least in enumerate(thresholds):
        free, start = np.ones(len(ignored), bool), 0
        for end in ends if len(det) else ():
            open_ = start + np.flatnonzero(free[label[start:end]] & (score[start:end] >= least))
            open_ = open_[np.append(True, np.diff(det[open_]) != 0)[: len(open_)]]
            out[t, det[open_]] = label[open_]
            free[label[open_]], start = False, end
    return out


def sized_precision(pred: DataFrame, gt: DataFrame, thresholds: list[float] = THRESHOLDS, most: int = 100, ranges: dict[str, tuple[float, float]] = SIZES) -> DataFrame:
    """(size, ap, ap50): mean over classes of the precision at 101 recalls, for objects of a range of areas.

    Labels outside the range are ignored, and so are detections that take one, or that take none and
    are outside themselves; the ``most`` best detections of an image and class count. Matching is
    sequential inside an image and class; Python does it for all images of a batch at once. It returns
    one row a detection, with a bit a threshold, ranked by the two-level scans; hits are aggregated by
    the recall they reach.
    """
    box, names = ["x1", "y1", "x2", "y2"], list(ranges)
    rows = pred.select("image_id", "cls", F.col("det_id").alias("id"), "conf", *box).unionByName(gt.select("image_id", "cls", F.col("gt_id").alias("id"), F.lit(None).cast("double").alias("conf"), *box))
    rows = rows.withColumn("n_", F.row_number().over(Window.partitionBy("image_id").orderBy("cls", F.desc_nulls_last("conf"), "id")))
    bits = 1 << np.arange(len(thresholds), dtype=np.int64)
    columns = ["cls", "image_id", "det_id", "conf", *[f"{c}{i}" for i in range(len(names)) for c in ("hit", "skip")], "labels"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, "image_id"):
            at, conf, cls = pdf[box].to_numpy(float), pdf["conf"].to_numpy(float), pdf["cls"].to_numpy()
            size = (at[:, 2] - at[:, 0]) * (at[:, 3] - at[:, 1])
            starts = np.array([part.start for part in group_slices(pdf, "image_id", "cls")])
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(pdf))))
            turn, is_gt = np.arange(len(pdf)) - starts[group], np.isnan(conf)  # detections come first in their group, best first
            d, g = np.flatnonzero(~is_gt & (turn < most)), np.flatnonzero(is_gt)
            held = np.bincount(group[g], minlength=len(starts))
            first = np.cumsum(held) - held
            n = held[group[d]]
            i = np.repeat(np.arange(len(d)), n)
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[group[d]][i]
            inter = np.prod(np.clip(np.minimum(at[d[i], 2:], at[g[j], 2:]) - np.maximum(at[d[i], :2], at[g[j], :2]), 0, None), 1)
            near = inter > 0
            i, j, inter = i[near], j[near], inter[near]
            score = inter / (size[d[i]] + size[g[j]] - inter)
            near = score >= min(thresholds)
            i, j, score = i[near], j[near], score[near]
            out, counts = {"cls": cls[d], "image_id": pdf["image_id"].to_numpy()[d], "det_id": pdf["id"].to_numpy()[d], "conf": conf[d]}, []
            for k, name in enumerate(names):
                least, top = ranges[name]
                outside = (size < least) | (size > top)
                took = sized_matches(i, j, score, turn[d], outside[g], thresholds)
                skip = np.where(took >= 0, outside[g][took] if len(g) else False, outside[d][None])
                out[f"hit{k}"], out[f"skip{k}"] = bits @ ((took >= 0) & ~skip), bits @ skip
                counts.append(~outside[g])
            yield pd.DataFrame(out | {"labels": None})[columns]
            found = pd.DataFrame({"cls": cls[g]} | {f"{k}": c for k, c in enumerate(counts)}).groupby("cls").sum()
            yield pd.DataFrame({"cls": found.index, "labels": found.to_numpy().tolist()}).reindex(columns=columns)

    made = written(rows.mapInPandas(run, "cls int, image_id long, det_id int, conf double, " + ", ".join(f"hit{i} long, skip{i} long" for i in range(len(names))) + ", labels array<long>"))
    labels = made.where("labels is not null").select("cls", F.posexplode("labels").alias("r", "n")).groupBy("r", "cls").agg(F.sum("n").alias("n_labels")).where("n_labels > 0")
    labels = settled(labels.withColumn("size", F.element_at(F.array(*map(F.lit, names)), F.col("r") + 1)).select("size", "cls", "n_labels").coalesce(1))  # a row a range and class
    each = F.filter(F.array(*[F.struct(F.lit(name).alias("size"), F.col(f"hit{i}").alias("hit"), F.col(f"skip{i}").alias("skip")) for i, name in enumerate(names)]), lambda z: z["skip"] < int(bits.sum()))
    found = made.where("labels is null").select("cls", "image_id", "det_id", "conf", F.explode(each).alias("z")).select("cls", "image_id", "det_id", "conf", "z.*")
    found = found.withColumn("bucket", (-F.floor(F.col("conf") * parts_for(made.count()))).cast("long"))
    bit = lambda c, t: F.getbit(F.col(c), F.lit(t)).cast("int")
    sums = {f"{c}{t}": v for t in range(len(thresholds)) for c, v in (("c", bit("hit", t)), ("n", 1 - bit("skip", t)))}
    keys = ["size", "cls", "t"]
    found = running_sums(found, ["size", "cls"], "bucket", [F.desc("conf"), F.col("image_id"), F.col("det_id")], sums)
    hit = F.array_compact(F.array(*[F.when(bit("hit", t) == 1, F.struct(F.lit(t).alias("t"), F.col(f"c{t}").alias("cum_tp"), F.col(f"n{t}").alias("n"))) for t in range(len(thresholds))]))
    hits = found.where("hit > 0").select("size", "cls", F.explode(hit).alias("h")).select("size", "cls", "h.*").join(F.broadcast(labels), ["size", "cls"])
    # the hit that first reaches recall k / 100 gives the precision there, or a better one after it
    recall = F.col("cum_tp") / F.col("n_labels")
    step = first_step(recall, 100.0)
    runs = hits.groupBy(*keys, F.when(step / 100.0 > recall, step - 1).otherwise(step).alias("reached")).agg(F.max(F.col("cum_tp") / F.col("n")).alias("top"))
    env = F.max("top").over(Window.partitionBy(*keys).orderBy(F.desc("reached")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    steps = F.col("reached") - F.coalesce(F.lag("reached").over(Window.partitionBy(*keys).orderBy("reached")), F.lit(-1))
    ap = runs.withColumn("y", env * steps).groupBy(*keys).agg((F.sum("y") / 101).alias("ap"))
    every = labels.select("size", "cls", F.explode(F.array(*map(F.lit, range(len(thresholds))))).alias("t")).join(ap, keys, "left").fillna(0.0, ["ap"])
    return every.groupBy("size").agg(F.avg("ap").alias("ap"), F.avg(F.when(F.col("t") == 0, F.col("ap"))).alias("ap50"))
