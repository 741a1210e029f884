"""Joins on space beyond detection matching: optimal assignment, keypoints, masks, tracks, prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.boxes import area, cols, extended_iou, intersection, iou, overlaps, union_area, xywh_to_xyxy
from tessera.functions.kernels import group_slices, whole_groups
from tessera.storage import settled
from tessera.streaming.assign import hungarian
from tessera.streaming.assign import match as assign

from .evaluation import pairs


def optimal_match(pred: DataFrame, gt: DataFrame, least: float = 0.5) -> DataFrame:
    """(image_id, det_id, gt_id, iou) of greatest total IoU among pairs of one class with IoU ≥ ``least``.

    Pairs are found by the join; a pair whose ends have no other candidate needs no solver. What is
    left goes to the solver an image at a time, many images to an Arrow batch.
    """
    rows = pairs(pred, gt).where(F.col("iou") >= least).select("image_id", "det_id", "gt_id", "iou")
    count = lambda c: F.count(F.lit(1)).over(Window.partitionBy("image_id", c))
    rows = rows.withColumns({"nd": count("det_id"), "ng": count("gt_id")})
    alone = (F.col("nd") == 1) & (F.col("ng") == 1)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, "image_id"):
            d, g, iou, keep = pdf["det_id"].to_numpy(), pdf["gt_id"].to_numpy(), pdf["iou"].to_numpy(), np.zeros(len(pdf), bool)
            for part in group_slices(pdf, "image_id"):
                dets, i = np.unique(d[part], return_inverse=True)
                labels, j = np.unique(g[part], return_inverse=True)
                if len(dets) == 1 or len(labels) == 1:
                    keep[part.start + int(np.argmax(iou[part]))] = True
                    continue
                cost, at = np.full((len(dets), len(labels)), 1e3), np.zeros((len(dets), len(labels)), int)
                cost[i, j], at[i, j] = 1 - iou[part], np.arange(part.start, part.stop)
                for a, b in assign(cost, 1.0):
                    keep[at[a, b]] = True
            yield pdf[keep]

    hard = rows.where(~alone).select("image_id", "det_id", "gt_id", "iou")
    hard = hard.repartition("image_id").sortWithinPartitions("image_id", "det_id", "gt_id").mapInPandas(solve, hard.schema)
    return rows.where(alone).select("image_id", "det_id", "gt_id", "iou").unionByName(hard)


def keypoint_similarity(a: Column, b: Column, size: Column, sigmas: list[float]) -> Column:
    """Mean of exp(-d² / (2 σ)² / size / 2) over the visible points of ``a`` (arrays of struct<x, y, v>); 0 if none is."""
    spread = F.array(*[F.lit((2 * s) ** 2) for s in sigmas])
    part = F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), spread.alias("s")), lambda z: F.when(z["a"]["v"] > 0, F.exp(-((z["a"]["x"] - z["b"]["x"]) ** 2 + (z["a"]["y"] - z["b"]["y"]) ** 2) / z["s"] / (size + 1e-7) / 2)))
    seen = F.array_compact(part)
    return F.when(F.size(seen) > 0, F.aggregate(seen, F.lit(0.0), lambda s, x: s + x) / F.size(seen)).otherwise(0.0)


def mask_pairs(p: DataFrame, g: DataFrame, join: Callable[[DataFrame, DataFrame, Column, Column], DataFrame], pixels: Callable[[Column], Column] = lambda shape: shape["px"]) -> DataFrame:
    """The columns of ``p`` and ``g`` (image_id, shape, first, last, ..) with ``iou``, for masks of one image.

    ``pixels`` lists the pixels of a ``shape`` (a struct), ascending and without repeats, from ``first`` to
    ``last``. Masks meet by image and by that range, and only pairs that met are listed: what is dealt
    out, sorted and written is a shape, not its pixels. What two masks share is counted within a row.
    Pairs that share none have ``iou`` 0. ``join(p, g, image, near)`` joins them.
    """
    once = lambda c: F.explode(F.array(c))  # noqa: E731  # what is costly is made here, and not again in each expression or filter that reads it
    ends = ("shape", "first", "last")
    side = lambda df, t: [F.col(c).alias(f"{t}_{c}") if c in ends else F.col(c) for c in df.columns if c != "image_id"]
    p, g = p.select("image_id", *side(p, "p")), g.select(F.col("image_id").alias("i_"), *side(g, "g"))
    near = (F.col("p_first") <= F.col("g_last")) & (F.col("g_first") <= F.col("p_last"))
    listed = F.struct(pixels(F.col("p_shape")).alias("p"), pixels(F.col("g_shape")).alias("g"))
    rows = join(p, g, F.col("image_id") == F.col("i_"), near).select("*", once(listed).alias("px_"))
    rows = rows.select("*", once(F.size(F.array_intersect("px_.p", "px_.g"))).alias("both"))
    rows = rows.withColumn("iou", F.col("both") / (F.size("px_.p") + F.size("px_.g") - F.col("both")))
    return rows.drop("i_", "px_", "both", *[f"{t}_{c}" for t in "pg" for c in ends])


def mask_iou(a: DataFrame, b: DataFrame, pixels: Callable[[Column], Column] = lambda shape: shape["px"]) -> DataFrame:
    """(image_id, a, b, iou) of masks (image_id, a or b, shape, first, last) that share a pixel; see :func:`mask_pairs`."""
    return mask_pairs(a, b, lambda p, g, image, near: p.join(g, image & near), pixels).where(F.col("iou") > 0).select("image_id", "a", "b", "iou")


def duplicate_tracks(a: DataFrame, b: DataFrame, limit: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """``a`` and ``b`` (stream_id, track_id, age, box) without the younger of two tracks within ``limit``; on a tie that of ``a`` goes."""
    x = a.select("stream_id", F.col("track_id").alias("ta"), F.col("age").alias("aa"), *[F.col(c).alias(f"a{c}") for c in ("x1", "y1", "x2", "y2")])
    y = b.select(F.col("stream_id").alias("s_"), F.col("track_id").alias("tb"), F.col("age").alias("ab"), *[F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")])
    p, q = cols("ax1", "ay1", "ax2", "ay2"), cols("bx1", "by1", "bx2", "by2")
    near = x.join(y, (F.col("stream_id") == F.col("s_")) & overlaps(p, q) & (1 - iou(p, q) < limit))
    drop_a = near.where("aa <= ab").select("stream_id", F.col("ta").alias("track_id"))
    drop_b = near.where("aa > ab").select("stream_id", F.col("tb").alias("track_id"))
    return a.join(drop_a, ["stream_id", "track_id"], "left_anti"), b.join(drop_b, ["stream_id", "track_id"], "left_anti")


def aligned_candidates(pred: DataFrame, gt: DataFrame, k: int = 10, alpha: float = 0.5, beta: float = 6.0) -> DataFrame:
    """(image_id, det_id, gt_id, metric): of detections centred in a label's box, its ``k`` best by score^α · IoU^β; a detection goes to the label it overlaps most."""
    p = pred.select("image_id", "det_id", "conf", *[F.col(c).alias(f"p{c}") for c in ("x1", "y1", "x2", "y2")])
    g = gt.select(F.col("image_id").alias("i_"), "gt_id", *[F.col(c).alias(f"g{c}") for c in ("x1", "y1", "x2", "y2")])
    cx, cy = (F.col("px1") + F.col("px2")) / 2, (F.col("py1") + F.col("py2")) / 2
    inside = (cx > F.col("gx1")) & (cx < F.col("gx2")) & (cy > F.col("gy1")) & (cy < F.col("gy2"))
    rows = p.join(g, (F.col("image_id") == F.col("i_")) & inside).withColumn("iou", iou(cols("gx1", "gy1", "gx2", "gy2"), cols("px1", "py1", "px2", "py2")))
    rows = rows.withColumn("metric", F.pow("conf", F.lit(alpha)) * F.pow("iou", F.lit(beta)))
    best = Window.partitionBy("image_id", "gt_id").orderBy(F.desc("metric"), "det_id")
    rows = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    owner = Window.partitionBy("image_id", "det_id").orderBy(F.desc("iou"), "gt_id")
    return rows.withColumn("n", F.row_number().over(owner)).where("n = 1").select("image_id", "det_id", "gt_id", "metric")


def cover(boxes: DataFrame, x0: float, y0: float, x1: float, y1: float, most: float) -> DataFrame:
    """Boxes of which the rectangle covers a share below ``most``."""
    hidden = intersection(cols("x1", "y1", "x2", "y2"), (F.lit(x0), F.lit(y0), F.lit(x1), F.lit(y1)))
    return boxes.where(hidden / area(cols("x1", "y1", "x2", "y2")) < most)


def cover_union(boxes: DataFrame, rects: list[tuple[float, float, float, float]], most: float) -> DataFrame:
    """Boxes of which the rectangles together cover a share below ``most``."""
    held = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(r, ("x1", "y1", "x2", "y2"), strict=True)]) for r in rects])
    b = cols("x1", "y1", "x2", "y2")
    return boxes.where(union_area(b, held) / area(b) < most)


def select_by_prompts(masks: DataFrame, prompts: DataFrame) -> DataFrame:
    """(image_id, det_id): for each prompt box the mask box of greatest IoU, together without repeats.

    Only overlapping pairs are joined; a prompt that overlaps no mask takes its image's first one.
    """
    p = prompts.select(F.col("image_id").alias("i_"), F.col("gt_id").alias("prompt"), *[F.col(c).alias(f"g{c}") for c in ("x1", "y1", "x2", "y2")])
    a, b = cols("gx1", "gy1", "gx2", "gy2"), cols("x1", "y1", "x2", "y2")
    rows = masks.join(p, (F.col("image_id") == F.col("i_")) & overlaps(a, b)).withColumn("iou", iou(a, b))
    best = rows.groupBy("image_id", "prompt").agg(F.max_by("det_id", F.struct("iou", -F.col("det_id"))).alias("det_id"))
    bare = p.join(best, (F.col("i_") == F.col("image_id")) & (p["prompt"] == best["prompt"]), "left_anti").select(F.col("i_").alias("image_id")).distinct()
    first = masks.groupBy("image_id").agg(F.min("det_id").alias("det_id")).join(bare, "image_id", "left_semi")
    return best.select("image_id", "det_id").unionByName(first).distinct()


def mutual_nearest(candidates: DataFrame, limit: float, step: float = 0.05, rounds: int = 20) -> DataFrame:
    """(g, a, b): pairs that are each other's nearest among what is left of their group, below a limit that falls by ``step`` a round.

    ``candidates`` are sparse (g, a, b, cost). A round is two minima by window and two anti-joins;
    ties go to the lower id on the other side.
    """
    left, found = settled(candidates.where(F.col("cost") < limit).select("g", "a", "b", "cost")), None
    for _ in range(rounds):
        if limit <= 0 or left.isEmpty():
            break
        by_a, by_b = Window.partitionBy("g", "a").orderBy("cost", "b"), Window.partitionBy("g", "b").orderBy("cost", "a")
        ranked = left.withColumns({"ra": F.row_number().over(by_a), "rb": F.row_number().over(by_b)})
        chosen = settled(ranked.where((F.col("ra") == 1) & (F.col("rb") == 1) & (F.col("cost") < limit)).select("g", "a", "b"))
        found = chosen if found is None else found.unionByName(chosen)
        limit -= step
        left = settled(left.join(chosen, ["g", "a"], "left_anti").join(chosen, ["g", "b"], "left_anti").where(F.col("cost") < limit).select("g", "a", "b", "cost"))
    return found if found is not None else left.select("g", "a", "b")


def track_costs(tracks: DataFrame, pred: DataFrame, conf_weight: float = 0.1, least_iou: float = 0.1) -> DataFrame:
    """(image_id, gt_id, det_id, cost) of tracks (image_id, gt_id, box, score, prev_score) and detections that overlap enough: one less the IoU weighted by the overlap of their heights, plus the gap between the track's projected score and the detection's."""
    t = tracks.select(F.col("image_id").alias("i_"), "gt_id", "score", "prev_score", *[F.col(c).alias(f"t{c}") for c in ("x1", "y1", "x2", "y2")])
    a, b = cols("tx1", "ty1", "tx2", "ty2"), cols("x1", "y1", "x2", "y2")
    rows = t.join(pred, (F.col("image_id") == F.col("i_")) & overlaps(a, b)).withColumn("iou", iou(a, b)).where(F.col("iou") > least_iou)
    high = (F.least(a[3], b[3]) - F.greatest(a[1], b[1])) / (F.greatest(a[3], b[3]) - F.least(a[1], b[1]) + 1e-9)
    unit = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    projected = F.col("score") + (F.col("score") - F.col("prev_score"))
    return rows.select("image_id", "gt_id", "det_id", unit(1 - unit(high) * F.col("iou") + conf_weight * F.abs(projected - F.col("conf"))).alias("cost"))


def fused_cost(overlap: Column, score: Column) -> Column:
    """One less overlap times the detection's score."""
    return 1 - overlap * score


def appearance_cost(overlap: Column, a: Column, b: Column, least_overlap: float = 0.5, least_similarity: float = 0.8) -> Column:
    """The lesser of the overlap's cost and the embeddings' (half of one less their cosine), which counts only for pairs near enough in place and in looks; without embeddings the overlap's alone."""
    from tessera.functions.shapes import cosine

    looks = F.greatest(F.lit(0.0), (1 - cosine(a, b)) / 2)
    near = (overlap >= least_overlap) & (looks <= 1 - least_similarity)
    return F.least(1 - overlap, F.when(near & a.isNotNull() & b.isNotNull(), looks).otherwise(F.lit(1.0)))


def set_match(pred: DataFrame, gt: DataFrame, weights: tuple[float, float, float] = (1.0, 5.0, 2.0), alpha: float = 0.25, gamma: float = 2.0) -> DataFrame:
    """(image_id, det_id, gt_id): the assignment of least total cost between an image's queries (cx, cy, w, h, ``scores`` by class) and its labels.

    Cost is a focal class cost, the sum of absolute box differences and one less the generalised IoU, by
    ``weights``; numbers that are none count 0. As many pairs as the smaller side has. All pairs of an
    image take part, as the assignment is over the full matrix; they are columns, the solver is Python.
    """
    g = gt.select(F.col("image_id").alias("i_"), "gt_id", F.col("cls").alias("gcls"), *[F.col(c).alias(f"g{c}") for c in ("cx", "cy", "w", "h")])
    rows = pred.join(g, F.col("image_id") == F.col("i_"))
    p, eps = F.get("scores", F.col("gcls")), 1e-8
    focal = alpha * (1 - p) ** gamma * -F.log(p + eps) - (1 - alpha) * p**gamma * -F.log(1 - p + eps)
    apart = sum((F.abs(F.col(c) - F.col(f"g{c}")) for c in ("cx", "cy", "w", "h")), F.lit(0.0))
    giou = extended_iou(xywh_to_xyxy(cols("cx", "cy", "w", "h")), xywh_to_xyxy(cols("gcx", "gcy", "gw", "gh")))["giou"]
    cost = weights[0] * focal + weights[1] * apart + weights[2] * (1 - giou)
    rows = rows.select("image_id", "det_id", "gt_id", F.when(F.isnan(cost) | cost.isNull() | (F.abs(cost) == float("inf")), 0.0).otherwise(cost).alias("cost"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, "image_id"):
            d, g, c, keep = pdf["det_id"].to_numpy(), pdf["gt_id"].to_numpy(), pdf["cost"].to_numpy(), np.zeros(len(pdf), bool)
            for part in group_slices(pdf, "image_id"):
                dets, i = np.unique(d[part], return_inverse=True)
                labels, j = np.unique(g[part], return_inverse=True)
                n = max(len(dets), len(labels))
                square, at = np.zeros((n, n)), np.full((n, n), -1)
                square[i, j], at[i, j] = c[part], np.arange(part.start, part.stop)
                chosen = at[np.arange(n), hungarian(square)]
                keep[chosen[chosen >= 0]] = True
            yield pdf.loc[keep, ["image_id", "det_id", "gt_id"]]

    return rows.repartition("image_id").sortWithinPartitions("image_id", "det_id", "gt_id").mapInPandas(solve, rows.drop("cost").schema)


def mined_low_scores(loose: DataFrame, tight: DataFrame, high: float) -> DataFrame:
    """Detections that only the loose suppression keeps, below ``high``."""
    return loose.where(F.col("conf") < high).join(tight.select("image_id", "det_id"), ["image_id", "det_id"], "left_anti")
