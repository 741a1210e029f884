from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels as k
from tessera.functions.shapes import polygon

SQUARE = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)


def test_clipping_and_share():
    assert k.shoelace(k.clip_to_window(SQUARE, 2, 2, 9, 9)) == 4 and k.foreground_share(SQUARE, (2, 0, 9, 9)) == 0.5
    assert k.foreground_share(SQUARE, (5, 5, 6, 6)) == 0 and k.foreground_share(SQUARE, (-1, -1, 9, 9)) == 1
    triangle = np.array([(0, 0), (4, 0), (0, 4)], float)
    r = np.random.default_rng(0).random((200_000, 2)) * 4
    hit = (r.sum(1) < 4) & (r[:, 0] > 1) & (r[:, 1] < 2)
    assert k.shoelace(k.clip_to_window(triangle, 1, 0, 9, 2)) == pytest.approx(16 * hit.mean(), abs=0.1)


def test_resample_hull_and_rectangle():
    p = k.resample(SQUARE, 9)
    assert p[0].tolist() == p[-1].tolist() == [0, 0] and p[1].tolist() == [2, 0]
    assert len(k.hull(np.concatenate([SQUARE, [[1, 1], [2, 0]]]))) == 4
    for cx, cy, w, h, t in [(5, 6, 8, 3, 0.4), (0, 0, 2, 2, 0.0), (1, 2, 9, 1, 1.2)]:
        turn = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
        pts = np.array([(-w, -h), (w, -h), (w, h), (-w, h)]) / 2 @ turn.T + (cx, cy)
        assert k.least_rectangle(pts) == pytest.approx((cx, cy, w, h, t), abs=1e-6)


def test_fill_regions_and_outline():
    mask = k.fill(SQUARE, 6, 6)
    assert mask.sum() == 16 and mask[:4, :4].all()
    ring = k.outline(mask)
    assert sorted(map(tuple, ring.tolist())) == [(0, 0), (0, 4), (4, 0), (4, 4)]
    r = np.random.default_rng(1)
    blob = np.zeros((12, 12), bool)
    blob[3:9, 2:7], blob[5:7, 7:10], blob[0, 0] = True, True, True
    again = k.fill(k.outline(blob), 12, 12)
    blob[0, 0] = False
    assert np.array_equal(again, blob)
    noisy = blob.copy()
    noisy[0, 0], noisy[5, 4] = True, False
    assert np.array_equal(k.drop_small(k.drop_small(noisy, 4), 4, holes=True), blob)
    assert k.drop_small(np.eye(3, dtype=bool), 5).sum() == 1 and k.outline(np.zeros((3, 3))).shape == (0, 2)
    assert set(np.unique(k.overlap_mask([SQUARE, SQUARE / 2], 6, 6))) == {0, 1, 2} and r is not None


def test_bridge_keeps_area():
    other = SQUARE + (10, 0)
    joined = k.bridge([SQUARE, other, other + (0, 10)])
    assert k.shoelace(joined) == pytest.approx(48) and np.array_equal(k.bridge([SQUARE]), SQUARE)


def test_columns(spark):
    df = spark.range(1).select(polygon([(0, 0), (4, 0), (4, 4), (0, 4)]).alias("p"), F.array(*[F.lit(float(x)) for x in (2, 0, 9, 9)]).alias("w"))
    row = df.select(k.iof_column(F.col("p"), F.col("w")).alias("s"), k.rectangle_column(F.col("p")).alias("r"), k.resample_column(F.col("p"), 5).alias("n")).first()
    assert row.s == 0.5 and row.r.w * row.r.h == pytest.approx(16) and len(row.n) == 5
    empty = df.select(F.array().cast(k.POINTS).alias("p")).select(k.rectangle_column(F.col("p")).alias("r"), k.resample_column(F.col("p"), 5).alias("n")).first()
    assert empty.r.w is None or np.isnan(empty.r.w)
    assert empty.n == []
