"""Operators against numpy twins and hand-made cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import boxes as bx
from tessera.functions import shapes as sh
from tessera.operators import evaluation as ev
from tessera.operators import results, sampling, scans, spatial, suppress, tiling, tracks, vectors

BOX = "image_id long, det_id int, cls int, x1 double, y1 double, x2 double, y2 double, conf double"


def random_boxes(n, images=3, seed=0):
    r = np.random.default_rng(seed)
    xy, wh = r.random((n, 2)) * 100, r.random((n, 2)) * 60 + 5
    return [(int(i % images), i, int(r.integers(2)), *map(float, xy[i]), *map(float, xy[i] + wh[i]), float(np.round(r.random(), 2))) for i in range(n)]


def test_matching_is_not_best_iou_twice(spark):
    """The label takes its most confident candidate, though another one overlaps it more; the loser is not matched anew."""
    gt = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 10.0, 10.0)], "image_id long, gt_id int, cls int, x1 double, y1 double, x2 double, y2 double")
    pred = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 10.0, 8.0, 0.9), (0, 1, 0, 0.0, 0.0, 10.0, 10.0, 0.5)], BOX)
    got = {(round(r.thr, 2), r.det_id) for r in ev.match(pred, gt).collect()}
    assert got == {(t, 0) for t in (0.5, 0.55, 0.6, 0.65, 0.7, 0.75)} | {(0.8, 0) if (80 / (100 + 1e-7)) >= 0.8 else (0.8, 1)} | {(0.85, 1), (0.9, 1), (0.95, 1)}
    assert [r.det_id for r in ev.match_any_class(pred, gt).collect()] == [1]


def average_precision(tp, n):
    tp = np.asarray(tp, float)
    recall, precision = np.cumsum(tp) / (n + 1e-16), np.cumsum(tp) / np.arange(1, len(tp) + 1)
    r, p = np.concatenate([[0], recall, [recall[-1], 1]]), np.concatenate([[1], precision, [0, 0]])
    p = np.flip(np.maximum.accumulate(np.flip(p)))
    x = np.arange(101) / 100
    y = np.interp(x, r, p)
    return float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())


@pytest.mark.parametrize("seed", range(4))
def test_average_precision(spark, seed):
    r = np.random.default_rng(seed)
    tp, labels = (r.random(60) < 0.5).astype(int), 45
    rows = [(0.5, 0, i, i, float(1 - i / 100), int(t)) for i, t in enumerate(tp)]
    pred = spark.createDataFrame([(i, i, 0, 0.0, 0.0, 1.0, 1.0, c) for _, _, i, _, c, _ in rows], BOX)
    hits = spark.createDataFrame([(0.5, i, i, 0) for _, _, i, _, _, t in rows if t], "thr double, image_id long, det_id int, gt_id int")
    gt = spark.createDataFrame([(i, 0, 0) for i in range(labels)] + [(0, 1, 1)], "image_id long, gt_id int, cls int")
    got = {row.cls: row.ap for row in ev.average_precision(ev.curve(pred, hits, [0.5]), gt, [0.5]).collect()}
    assert got[0] == pytest.approx(average_precision(tp, labels), abs=1e-9) and got[1] == 0.0


def test_confidence_curves(spark):
    r = np.random.default_rng(3)
    conf, tp = np.round(np.sort(r.random(40))[::-1], 3), (r.random(40) < 0.6).astype(int)
    conf = np.unique(conf)[::-1]
    tp = tp[: len(conf)]
    pred = spark.createDataFrame([(i, i, 0, 0.0, 0.0, 1.0, 1.0, float(c)) for i, c in enumerate(conf)], BOX)
    hits = spark.createDataFrame([(0.5, i, i, 0) for i, t in enumerate(tp) if t], "thr double, image_id long, det_id int, gt_id int")
    gt = spark.createDataFrame([(i, 0, 0) for i in range(30)], "image_id long, gt_id int, cls int")
    got = sorted((row.k, row.p, row.r) for row in ev.confidence_curves(ev.curve(pred, hits, [0.5]), gt).collect())
    x = np.linspace(0, 1, 1000)
    recall, precision = np.cumsum(tp) / 30, np.cumsum(tp) / np.arange(1, len(tp) + 1)
    assert np.allclose([g[2] for g in got], np.interp(-x, -conf, recall, left=0), atol=1e-6)
    assert np.allclose([g[1] for g in got], np.interp(-x, -conf, precision, left=1), atol=1e-6)


def test_smoothing_equals_a_convolution(spark):
    y = np.random.default_rng(0).random(100)
    n = round(100 * 0.1 * 2) // 2 + 1
    pad = np.ones(n // 2)
    want = np.convolve(np.concatenate([pad * y[0], y, pad * y[-1]]), np.ones(n) / n, mode="valid")
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "k int, y double")
    assert np.allclose([r.s for r in ev.smooth(df, "k", "y", 100, 0.1, "s").orderBy("k").collect()], want)


@pytest.mark.parametrize("thr", [0.3, 0.6])
def test_suppression(spark, thr):
    rows = random_boxes(80)
    df = spark.createDataFrame(rows, BOX)
    b = np.array([r[3:7] for r in rows])
    low, high = np.maximum(b[:, None, :2], b[None, :, :2]), np.minimum(b[:, None, 2:], b[None, :, 2:])
    inter, size = np.prod(np.clip(high - low, 0, None), -1), np.prod(b[:, 2:] - b[:, :2], -1)
    iou = inter / (size[:, None] + size[None] - inter)
    order = sorted(range(80), key=lambda i: (-rows[i][7], i))
    greedy, fast = [], []
    for k, i in enumerate(order):
        same = lambda j, i=i: rows[i][0] == rows[j][0] and rows[i][2] == rows[j][2]
        if not any(same(j) and iou[i, j] > thr for j in greedy):
            greedy.append(i)
        if not any(same(j) and iou[i, j] >= thr for j in order[:k]):
            fast.append(i)
    assert sorted(r.det_id for r in suppress.greedy_nms(df, thr).collect()) == sorted(greedy)
    assert sorted(r.det_id for r in suppress.fast_nms(df, thr).collect()) == sorted(fast)


def test_optimal_matching(spark):
    from itertools import permutations

    pred, gt = random_boxes(18, images=2, seed=5), random_boxes(12, images=2, seed=5)
    p = spark.createDataFrame(pred, BOX)
    g = spark.createDataFrame([(r[0], r[1], r[2], *(v + 2.0 for v in r[3:7])) for r in gt], "image_id long, gt_id int, cls int, x1 double, y1 double, x2 double, y2 double")
    iou = {(r.image_id, r.det_id, r.gt_id): r.iou for r in ev.pairs(p, g).where("iou >= 0.2").collect()}
    got = spatial.optimal_match(p, g, 0.2).collect()
    for image in (0, 1):
        dets, labels = sorted({d for i, d, _ in iou if i == image}), sorted({k for i, _, k in iou if i == image})
        slots = [*dets, *[None] * len(labels)]
        if len(labels) <= 5:
            best = max(sum(iou.get((image, d, k), 0) for d, k in zip(c, labels, strict=True)) for c in set(permutations(slots, len(labels))))
            assert sum(iou[image, r.det_id, r.gt_id] for r in got if r.image_id == image) == pytest.approx(best)
    assert len({(r.image_id, r.det_id) for r in got}) == len({(r.image_id, r.gt_id) for r in got}) == len(got)


def test_tile_order_ownership_and_filters(spark):
    images = spark.createDataFrame([(1, 100.0, 80.0), (2, 1.0, 1.0)], "image_id long, w double, h double")
    tiles = {(r.image_id, r.k): (r.x0, r.y0, r.x1, r.y1) for r in tiling.grid_2x2(images).collect()}
    assert [tiles[1, k] for k in range(4)] == [(0, 0, 60, 48), (0, 32, 60, 80), (40, 0, 100, 48), (40, 32, 100, 80)] and tiles[2, 3] == (0, 0, 1, 1)
    boxes = spark.createDataFrame([(1, 0, 0, 50.0, 10.0, 50.0 + 20, 20.0), (1, 1, 0, 59.5, 0.0, 90.0, 47.0)], "image_id long, gt_id int, cls int, x1 double, y1 double, x2 double, y2 double")
    grid = tiling.grid_2x2(images)
    held = lambda **k: sorted((r.k, r.gt_id) for r in tiling.tile_boxes(boxes, grid, **k).collect())
    assert held() == [(0, 0), (2, 0), (2, 1), (3, 1)] and held(centre=True, retain=1.0) == [(2, 0), (2, 1)] and held(whole=True) == [(2, 0), (2, 1)]
    assert sorted((r.k, r.gt_id) for r in tiling.validation_boxes(boxes, grid).collect()) == [(0, 0), (2, 0), (2, 1), (3, 1)]


def test_pool_of_four_has_41_slots(spark):
    n = spark.range(1, 10).withColumnRenamed("id", "n")
    stops = {r.n: r.m for r in tiling.pool_layout(n).groupBy("n").agg(F.max("stop").alias("m")).collect()}
    assert stops[4] == 41 and stops[1] == 10 and stops[3] == 30 and stops[5] == 52


def test_samples_are_exact_and_repeatable(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    pick = lambda share, seed="a": sorted(r.k for r in sampling.exact_sample(df, "k", share, seed).collect())
    assert len(pick(0.5)) == 502 and len(pick(0.0)) == 0 and len(pick(1.5)) == 1003 and pick(0.3) == pick(0.3) != pick(0.3, "b")
    parts = {r.split: r.n for r in sampling.split_712(df, "k", "s").groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert parts == {"train": 702, "val": 200, "test": 101}
    assert sampling.background_quota(df, "k", F.col("k") < 100, 0.5, "s").count() == 150 and sampling.background_quota(df, "k", F.col("k") < 100, -1, "s").count() == 1003


def test_global_rank_with_ties_and_nulls(spark):
    rows = [(None, 9), (None, 8)] + [(float(i % 7), i) for i in range(500)]
    got = scans.global_rank(spark.createDataFrame(rows, "v double, i long"), "v", "i").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.v, r.i) for r in sorted(got, key=lambda r: r.rank)] == want


def test_region_rules(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    pts = spark.createDataFrame([(1, 1, 5.0, 5.0), (2, 1, 10.0, 5.0), (3, 1, 10.9, 5.0), (4, 1, 11.0, 5.0)], "track_id long, frame int, x double, y double")
    assert tracks.region_counts(pts, {"s": square}).first().n == 1
    assert tracks.slot_occupancy(pts, {"s": square}).first().occupied == 1
    assert tracks.region_counts(pts, {"s": square}, edge=True, whole_pixels=True).first().n == 3
    assert tracks.region_counts(pts, {"s": square}, need_previous=True).count() == 0


def test_counter_rules(spark):
    line = [(430.0, 0.0), (430.0, 480.0)]
    xs = [(1, i + 1, float(x), 240.0) for i, x in enumerate((428, 436, 444, 436, 428, 420, 412))]
    pts = spark.createDataFrame(xs, "track_id long, frame int, x double, y double")
    assert [tuple(r) for r in tracks.line_crossings(pts, line).collect()] == [(1, 2, "in")]
    region = [(220.0, 140.0), (420.0, 140.0), (420.0, 340.0), (220.0, 340.0)]
    entries = lambda track, polygon=region: [r.direction for r in tracks.region_entries(spark.createDataFrame([(1, i + 1, float(x), float(y)) for i, (x, y) in enumerate(track)], "track_id long, frame int, x double, y double"), polygon).collect()]
    assert entries([(230, 240), (210, 240), (230, 240)]) == ["in"]  # spawned inside, out by the left edge, in again
    assert entries([(x, 240) for x in (428, 436, 444, 436, 428, 420, 412)]) == ["out"]  # turned back before it entered
    band = [(20.0, 360.0), (1080.0, 360.0), (1080.0, 400.0), (20.0, 400.0)]
    for polygon in (region, band):
        cx, cy = sum(p[0] for p in polygon) / 4, sum(p[1] for p in polygon) / 4
        for step, want in (((8, 0), "in"), ((-8, 0), "out"), ((0, 8), "in"), ((0, -8), "out")):
            assert entries([(cx + (i - 5) * step[0], cy + (i - 5) * step[1]) for i in range(6)], polygon) == [want]
    assert entries([(100, 240), (600, 240)]) == ["in"] and entries([(300, 500), (310, 20)]) == ["out"]  # straddles it between two frames
    assert entries([(100, 100), (600, 100)]) == [] and entries([(220, 140), (420, 140)]) == []  # beside it, along its edge
    notch = [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (60.0, 100.0), (60.0, 20.0), (40.0, 20.0), (40.0, 100.0), (0.0, 100.0)]
    assert entries([(45, 60), (55, 60)], notch) == [] and entries([(50, 60), (130, 60)], notch) == ["in"]


def test_seam_goes_where_few_boxes_are(spark):
    images = spark.createDataFrame([(1, 4000.0, 3000.0), (2, 1200.0, 900.0), (3, 1000.0, 1000.0)], "image_id long, w double, h double")
    r = np.random.default_rng(0)
    c, size = r.uniform(0.1, 0.9, (6, 2)), r.uniform(0.05, 0.15, (6, 2))
    at = np.concatenate([c - size / 2, c + size / 2], 1) * [4000, 3000, 4000, 3000]
    rows = [(1, *map(float, b)) for b in at] + [(3, 480.0, 0.0, 520.0, 40.0)]
    got = {x.image_id: (x.bias_x, x.bias_y) for x in tiling.seam_bias(images, spark.createDataFrame(rows, "image_id long, x1 double, y1 double, x2 double, y2 double")).collect()}
    places = np.linspace(0.25, 0.75, 32)
    want = []
    for k, side in ((0, 4000), (1, 3000)):
        reach = max(np.median(at[:, k + 2] - at[:, k]), side * 0.05) / 2
        want.append(places[(np.abs((at[:, k, None] + at[:, k + 2, None]) / 2 - places * side) < reach).sum(0).argmin()] - 0.5)
    assert got[1] == pytest.approx(tuple(want)) and got[2] == (0, 0) and got[3] == (-0.25, -0.25)
    moved = tiling.seam_bias(images, spark.createDataFrame(rows, "image_id long, x1 double, y1 double, x2 double, y2 double"), jitter=0.05, seed="3").collect()
    assert all(abs(x.bias_x - got[x.image_id][0]) <= 0.05 and -0.25 <= x.bias_x <= 0.25 for x in moved if x.image_id != 2)


def test_canvas_is_undone(spark):
    images = spark.createDataFrame([(1, 4000.0, 3000.0), (2, 301.0, 201.0)], "image_id long, w double, h double")
    boxes = spark.createDataFrame([(i, k, 1, 0, 10.0, 20.0, 110.0, 90.0) for i in (1, 2) for k in range(4)], "image_id long, k int, gt_id int, cls int, x1 double, y1 double, x2 double, y2 double")
    tiles = tiling.grid_2x2(images)
    a = {(r.image_id, r.k): (r.x1, r.y1, r.x2, r.y2) for r in tiling.to_original(boxes, tiles).collect()}
    b = {(r.image_id, r.k): (r.x1, r.y1, r.x2, r.y2) for r in tiling.to_original(tiling.to_canvas(boxes, tiles, 640), tiles, 640).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    seen = {r.image_id: (r.x1, r.y1) for r in tiling.to_canvas(boxes.where("k = 0"), tiles, 640).collect()}
    assert seen[1] == pytest.approx((10 * 640 / 2400, 20 * 640 / 2400 + 80)) and seen[2] == (10 + 230, 20 + 260)


def test_mutual_nearest(spark):
    rows = [(1, 0, 0, 0.1), (1, 0, 1, 0.6), (1, 1, 0, 0.2), (1, 1, 1, 0.3), (2, 5, 5, 0.48), (2, 5, 6, 0.2), (2, 6, 6, 0.1), (3, 1, 1, 0.9)]
    got = spatial.mutual_nearest(spark.createDataFrame(rows, "g long, a long, b long, cost double"), 0.5)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0), (1, 1, 1), (2, 6, 6)]


def test_top_k_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=8).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(map(tuple, vectors.top_k(df, df, 3).collect()))
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 13)
    assert sorted(map(tuple, vectors.top_k(df, df, 3).collect())) == want and len(want) == 180


def test_orders_cut_into_many_parts(spark, monkeypatch):
    monkeypatch.setattr(scans, "PART_ROWS", 20)
    df = spark.range(2000).selectExpr("id", "cast(id * 7919 % 301 as double) as v", "concat('k', id) as name").union(spark.sql("select -1L, cast(null as double), 'x'"))
    got = {r.id: r["rank"] for r in scans.global_rank(df, "v", "id").collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == [-1] + sorted(range(2000), key=lambda i: (i * 7919 % 301, i))
    ranks = {r.name: r["rank"] for r in sampling.ranked(df, "name", "s").collect()}
    import hashlib

    order = sorted(ranks, key=lambda n: hashlib.md5(f"{n}:s".encode()).hexdigest())
    assert [ranks[n] for n in order] == list(range(1, 2002))
    assert {r.name for r in sampling.exact_sample(df, "name", 0.3, "s").collect()} == set(order[:600])
    assert sampling.exact_sample(df, "name", 0.0, "s").count() == 0 and sampling.exact_sample(df, "name", 1.0, "s").count() == 2001


def test_geometry(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    assert value(bx.iou(lit(0, 0, 10, 10), lit(0, 0, 10, 10))) == pytest.approx(1, abs=1e-8) and value(bx.iou(lit(0, 0, 1, 1), lit(2, 2, 3, 3))) == 0
    assert value(bx.extended_iou(lit(0, 0, 1, 1), lit(2, 0, 3, 1))["giou"]) == pytest.approx(-1 / 3, abs=1e-6)
    assert value(bx.prob_iou(lit(5, 5, 4, 2, 0.3), lit(5, 5, 4, 2, 0.3))) == pytest.approx(1, abs=1e-3)
    assert value(sh.joint_angle(*lit(0, 1, 0, 0, 1, 0))) == pytest.approx(90) and value(sh.make_divisible(F.lit(33), 32)) == 64
    for box in [(3.0, 4.0, 10.0, 20.0)]:
        b = lit(*box)
        for there, back in ((bx.xyxy_to_xywh, bx.xywh_to_xyxy), (bx.xyxy_to_ltwh, bx.ltwh_to_xyxy)):
            assert [value(v) for v in back(there(b))] == list(box)
        assert [value(v) for v in bx.ltwh_to_xywh(bx.xywh_to_ltwh(b))] == list(box)
    triangle = [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)]
    assert value(sh.ring_area(sh.polygon(triangle))) == 8 and value(sh.ring_length(sh.polygon(triangle))) == pytest.approx(8 + 32**0.5)
    assert [value(v) for v in sh.bounds(sh.polygon(triangle))] == [0, 0, 4, 4]
    assert value(sh.inside(F.lit(1.0), F.lit(1.0), triangle)) and not value(sh.inside(F.lit(2.0), F.lit(2.0), triangle)) and value(sh.inside(F.lit(2.0), F.lit(2.0), triangle, edge=True))


def test_set_matcher_is_optimal(spark):
    from itertools import permutations

    r = np.random.default_rng(3)
    pred = [(g, i, *map(float, r.uniform(0.1, 0.9, 4)), r.uniform(0.01, 0.99, 3).tolist()) for g in (1, 2, 3) for i in range((5, 2, 3)[g - 1])]
    gt = [(g, i, int(r.integers(3)), *map(float, r.uniform(0.1, 0.9, 4))) for g in (1, 2, 3) for i in range((3, 4, 3)[g - 1])]
    p = spark.createDataFrame(pred, "image_id long, det_id int, cx double, cy double, w double, h double, scores array<double>")
    got = spatial.set_match(p, spark.createDataFrame(gt, "image_id long, gt_id int, cls int, cx double, cy double, w double, h double"))
    found = {g: sorted((x.det_id, x.gt_id) for x in got.collect() if x.image_id == g) for g in (1, 2, 3)}
    assert {g: len(v) for g, v in found.items()} == {1: 3, 2: 2, 3: 3}

    def cost(a, b):
        s, (ax, ay, aw, ah), (bx_, by, bw, bh) = a[6][b[2]], a[2:6], b[3:7]
        focal = 0.25 * (1 - s) ** 2 * -np.log(s + 1e-8) - 0.75 * s**2 * -np.log(1 - s + 1e-8)
        iw, ih = min(ax + aw / 2, bx_ + bw / 2) - max(ax - aw / 2, bx_ - bw / 2), min(ay + ah / 2, by + bh / 2) - max(ay - ah / 2, by - bh / 2)
        inter = max(0, iw) * max(0, ih)
        union = aw * ah + bw * bh - inter
        hull = (max(ax + aw / 2, bx_ + bw / 2) - min(ax - aw / 2, bx_ - bw / 2)) * (max(ay + ah / 2, by + bh / 2) - min(ay - ah / 2, by - bh / 2))
        return focal + 5 * (abs(ax - bx_) + abs(ay - by) + abs(aw - bw) + abs(ah - bh)) + 2 * (1 - (inter / union - (hull - union) / hull))

    for g in (1, 2, 3):
        ps, gs = [x for x in pred if x[0] == g], [x for x in gt if x[0] == g]
        n = min(len(ps), len(gs))
        best = min(sum(cost(ps[i], gs[j]) for i, j in (zip(c, range(n)) if len(gs) <= len(ps) else zip(range(n), c))) for c in permutations(range(max(len(ps), len(gs))), n))
        assert sum(cost(ps[i], gs[j]) for i, j in found[g]) == pytest.approx(best, abs=1e-5)


def test_whole_image_masks(spark):
    images = spark.createDataFrame([(1, 200.0, 100.0)], "image_id long, w double, h double")
    whole, half = (0.0, 0.0, 200.0, 100.0), (0.0, 0.0, 110.0, 100.0)
    rows = [
        (1, 0, 0, 0.9, 0.99, *whole, 30.0, 30.0, 60.0, 60.0), (1, 0, 1, 0.95, 0.99, *whole, 31.0, 30.0, 61.0, 60.0),  # the second suppresses the first
        (1, 1, 2, 0.92, 0.99, *half, 30.0, 31.0, 61.0, 61.0),  # the smaller crop's comes first
        (1, 1, 3, 0.99, 0.99, *half, 70.0, 20.0, 105.0, 50.0),  # at the crop's inner edge
        (1, 1, 4, 0.99, 0.2, *half, 40.0, 70.0, 60.0, 90.0), (1, 1, 5, 0.1, 0.99, *half, 40.0, 70.0, 60.0, 90.0),
        (1, 0, 6, 0.8, 0.99, *whole, 150.0, 5.0, 198.0, 45.0),  # at the image's own edge
    ]
    crops = spark.createDataFrame(rows, "image_id long, crop int, det_id int, conf double, stability double, cx0 double, cy0 double, cx1 double, cy1 double, x1 double, y1 double, x2 double, y2 double")
    got = {r.det_id: r.conf for r in results.whole_image_masks(crops, images, 0.5, 0.9, 0.7, 0.7).collect()}
    assert got == {2: 0.92, 6: 0.8}


def test_point_prompts(spark):
    masks = spark.createDataFrame([(i, k, 0.0 + 10 * k, 0.0, 10.0 + 10 * k, 10.0) for i in (1, 2) for k in range(3)], "image_id long, det_id int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 0, 5.0, 5.0, 1), (1, 1, 15.0, 5.0, 1), (1, 2, 16.0, 5.0, 0), (2, 0, 25.0, 5.0, 0)], "image_id long, place int, x double, y double, label int")
    assert sorted(map(tuple, results.select_by_points(masks, points).collect())) == [(1, 0), (2, 0), (2, 1)]


def test_split_fractions_and_epochs(spark):
    f = sampling.split_fraction
    assert [f(0.5, "train"), f(0.5, "val"), f([0.5, 10], "val"), f([0.5, 10], "test"), f([1, 1, 0], "test"), f(1, "train")] == [0.5, 1.0, 10, 1.0, 0.0, 1.0]
    for bad in ((0, "train"), ([1, 0], "val")):
        with pytest.raises(ValueError, match="no image"):
            f(*bad)
    df = spark.range(101).withColumnRenamed("id", "k")
    chosen = lambda *a, **k: {r.k for r in sampling.epoch_mask(df, "k", *a, **k).where("chosen").collect()}
    one, two = chosen(0.5, "s", 1, 10), chosen(0.5, "s", 2, 10)
    assert len(one) == len(two) == 50 and one != two and one == chosen(0.5, "s", 1, 10)
    assert chosen(0.5, "s", 8, 10, 2) == set() and len(chosen(1.0, "s", 1, 10)) == 101 and chosen(0.0, "s", 1, 10) == set()
    assert sampling.epoch_mask(df, "k", 0.5, "s", 9, 10, 1).count() == 101


def test_sized_precision_against_brute_force(spark):
    r = np.random.default_rng(11)
    gt, pred = [], []
    for i in range(12):
        for k in range(int(r.integers(0, 6))):
            x, y, w, h = *r.uniform(0, 300, 2), *r.choice([12, 25, 60, 90, 150], 2)
            c = int(r.integers(2))
            gt.append((i, k, c, float(x), float(y), float(x + w), float(y + h)))
            for _ in range(int(r.integers(0, 3))):
                j = r.normal(0, 0.06, 4) * [w, h, w, h]
                pred.append((i, len(pred), c if r.random() < 0.9 else 1 - c, float(x + j[0]), float(y + j[1]), float(x + w + j[2]), float(y + h + j[3]), float(round(r.random(), 2))))
        pred.append((i, len(pred), int(r.integers(2)), 0.0, 0.0, float(r.integers(5, 200)), 40.0, float(round(r.random(), 2))))
    area = lambda b: (b[5] - b[3]) * (b[6] - b[4])

    def iou(a, b):
        w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
        inter = max(0, w) * max(0, h)
        return inter / (area(a) + area(b) - inter)

    want = {}
    for size, (low, high) in ev.SIZES.items():
        out = lambda b: area(b) < low or area(b) > high  # noqa: B023, E731
        aps = []
        for c in (0, 1):
            n = sum(1 for g in gt if g[2] == c and not out(g))
            for t in ev.THRESHOLDS if n else []:
                rows = []
                for i in range(12):
                    mine, free = sorted((p for p in pred if p[0] == i and p[2] == c), key=lambda p: (-p[7], p[1])), [g for g in gt if g[0] == i and g[2] == c]
                    for p in mine:
                        best = max((g for g in free if not out(g) and iou(p, g) >= t), key=lambda g: iou(p, g), default=None) or max((g for g in free if out(g) and iou(p, g) >= t), key=lambda g: iou(p, g), default=None)
                        if best:
                            free.remove(best)
                        if not (out(best) if best else out(p)):
                            rows.append((-p[7], i, p[1], best is not None))
                tp = np.cumsum([x[3] for x in sorted(rows)])
                prec = np.maximum.accumulate((tp / np.arange(1, len(tp) + 1))[::-1])[::-1] if len(tp) else np.zeros(0)
                at = [int(np.searchsorted(tp / n, k / 100)) for k in range(101)] if len(tp) else []
                aps.append((t, sum(prec[a] for a in at if a < len(tp)) / 101))
        want[size] = (np.mean([a for _, a in aps]), np.mean([a for t, a in aps if t == 0.5])) if aps else None
    got = {x["size"]: (x.ap, x.ap50) for x in ev.sized_precision(spark.createDataFrame(pred, BOX), spark.createDataFrame(gt, "image_id long, gt_id int, cls int, x1 double, y1 double, x2 double, y2 double")).collect()}
    assert set(got) == {k for k, v in want.items() if v} and all(got[k] == pytest.approx(want[k]) for k in got)


def test_union_of_rectangles(spark):
    r = np.random.default_rng(5)
    rows = []
    for i in range(40):
        rects = [tuple(map(float, (x, y, x + w, y + h))) for x, y, w, h in r.integers(0, 12, (int(r.integers(0, 6)), 4))]
        rows.append((i, 2.0, 3.0, 15.0, 14.0, rects))
    df = spark.createDataFrame(rows, "i int, x1 double, y1 double, x2 double, y2 double, rects array<struct<x1:double,y1:double,x2:double,y2:double>>")
    got = {x.i: x.a for x in df.select("i", bx.union_area(bx.cols("x1", "y1", "x2", "y2"), F.col("rects")).alias("a")).collect()}
    for i, *_, rects in rows:
        mask = np.zeros((30, 30), bool)
        for a, b, c, d in rects:
            mask[int(b) : int(d), int(a) : int(c)] = True
        assert got[i] == mask[3:14, 2:15].sum()
