"""Non-maximum suppression and what goes with it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.boxes import area, cols, intersection, overlaps
from tessera.functions.kernels import group_slices, whole_groups


def top_by_confidence(pred: DataFrame, k: int) -> DataFrame:
    """The ``k`` most confident detections of each image; Spark ranks partially before it shuffles."""
    w = Window.partitionBy("image_id").orderBy(F.desc("conf"), "det_id")
    return pred.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def end_to_end(pred: DataFrame, conf: float, classes: list[int] | None, k: int) -> DataFrame:
    """Predictions that need no suppression: above ``conf``, of ``classes``, then the first ``k`` in the order given."""
    rows = pred.where(F.col("conf") > conf)
    rows = rows.where(F.col("cls").isin(classes)) if classes is not None else rows
    w = Window.partitionBy("image_id").orderBy("det_id")
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def fast_nms(pred: DataFrame, thr: float) -> DataFrame:
    """Drops a box that any box of its class and more confidence overlaps by ``thr`` or more, suppressed itself or not: an anti-join."""
    q = pred.select(F.col("image_id").alias("i_"), F.col("cls").alias("c_"), F.col("det_id").alias("d_"), F.col("conf").alias("s_"), *[F.col(c).alias(f"q{c}") for c in ("x1", "y1", "x2", "y2")])
    a, b = cols("x1", "y1", "x2", "y2"), cols("qx1", "qy1", "qx2", "qy2")
    inter = intersection(a, b)
    better = (F.col("s_") > F.col("conf")) | ((F.col("s_") == F.col("conf")) & (F.col("d_") < F.col("det_id")))
    on = (F.col("image_id") == F.col("i_")) & (F.col("cls") == F.col("c_")) & better & overlaps(a, b) & (inter / (area(a) + area(b) - inter) >= thr)
    return pred.join(q, on, "left_anti")


def kept_by_greedy(boxes: np.ndarray, group: np.ndarray, thr: float) -> np.ndarray:
    """Which boxes greedy suppression keeps, best first within the runs of equal ``group``; overlap is strictly above ``thr``.

    A round keeps the first box left of every group and drops those that it overlaps, in all groups at once.
    """
    areas, kept, left = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1]), np.zeros(len(boxes), bool), np.arange(len(boxes))
    while len(left):
        first = np.append(True, group[left[1:]] != group[left[:-1]])
        kept[left[first]] = True
        head, rest = left[first][np.cumsum(first) - 1][~first], left[~first]
        a, b = boxes[head], boxes[rest]
        inter = np.prod(np.clip(np.minimum(a[:, 2:], b[:, 2:]) - np.maximum(a[:, :2], b[:, :2]), 0, None), 1)
        over = inter > 0
        over[over] = inter[over] / (areas[head[over]] + areas[rest[over]] - inter[over]) > thr
        left = rest[~over]
    return kept


def greedy_nms(pred: DataFrame, thr: float, keys: tuple[str, ...] = ("image_id",), by_class: bool = True) -> DataFrame:
    """Greedy suppression within ``keys`` and class; ``det_id`` is unique within ``keys``.

    The window brings the boxes of ``keys`` together, best first, without an exchange where they are
    already; Python suppresses in all groups of an Arrow batch at once.
    """
    group, box = [*keys, *(["cls"] if by_class else [])], ["x1", "y1", "x2", "y2"]
    place = Window.partitionBy(*keys).orderBy(*group[len(keys) :], F.desc("conf"), "det_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, *keys):
            run_of = np.repeat(*np.array([(i, part.stop - part.start) for i, part in enumerate(group_slices(pdf, *group))]).T)
            yield pdf[kept_by_greedy(pdf[box].to_numpy(float), run_of, thr)].drop(columns="n_")

    return pred.withColumn("n_", F.row_number().over(place)).mapInPandas(run, pred.schema)
