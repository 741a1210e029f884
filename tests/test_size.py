"""Queries over large tables: how much they write between their steps, and their operators against plain loops."""

from __future__ import annotations

import random
import re
import time
from pathlib import Path

import numpy as np
import pytest

from tessera.operators import evaluation as ev
from tessera.operators import scans, suppress
from tessera.plans import augment_queries, registry, result_queries
from tessera.plans.canonical import table
from tessera.storage import CLEANUP, written

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(SF).is_dir(), reason="needs the driver's tables")


@pytest.fixture
def shared(spark, tmp_path):
    """A shared folder, as a cluster has it."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    conf = spark.sparkContext._conf
    conf.set("spark.checkpoint.dir", f"file://{tmp_path}")
    yield tmp_path
    conf._jconf.remove("spark.checkpoint.dir")


@needs_tables
@pytest.mark.parametrize("name", ["eval_frequency_groups", "eval_class_summary", "eval_ap_by_class", "eval_map", "eval_class_table", "eval_obb_ap", "eval_segment_metrics"])
def test_precision_writes_narrow_rows(spark, shared, name):
    """At most 24 bytes a prediction in the shared folder, and no row a threshold."""
    registry.queries()[name](spark, SF).collect()
    written = sum(f.stat().st_size for f in shared.rglob("*") if f.is_file())
    assert written < 24 * table(spark, SF, "pred").count()


@pytest.mark.parametrize("score", [ev.pairs, ev.rotated_pairs])
def test_ranked_are_the_matches(spark, score):
    """Equal scores, equal confidences, labels that several detections want, no label near, no image."""
    rng = random.Random(5)
    box = lambda: (x := rng.randrange(0, 12) * 2.0, y := rng.randrange(0, 6) * 2.0, x + rng.choice([10.0, 12.0]), y + rng.choice([10.0, 12.0]))
    pred = [(i, d, rng.randrange(2), *box(), rng.choice([0.2, 0.5, 0.9])) for i in range(40) for d in range(rng.randrange(6))] + [(None, 1, 0, 0.0, 0.0, 9.0, 9.0, 0.5)]
    gt = [(i, g, rng.randrange(2), *box()) for i in range(40) for g in range(rng.randrange(6))] + [(None, 1, 0, 0.0, 0.0, 9.0, 9.0)]
    p = spark.createDataFrame(pred, "image_id long, det_id int, cls int, x1 double, y1 double, x2 double, y2 double, conf double")
    g = spark.createDataFrame(gt, "image_id long, gt_id int, cls int, x1 double, y1 double, x2 double, y2 double")
    p, g = result_queries._rotated(p), result_queries._rotated(g)
    rows = ev.ranked(p, g, score).collect()
    assert len(rows) == len(pred)
    got = {(t, r.image_id, r.det_id) for r in rows for t in ev.THRESHOLDS[r.low : r.high]}
    assert got == {(r.thr, r.image_id, r.det_id) for r in ev.match_pairs(score(p, g)).collect()} and got


@needs_tables
def test_fusion_broadcasts_no_table(spark):
    """A table of images estimates its columns, not the tiles made of them; only the constants of the tables' SQL are sent out."""
    plan = registry.queries()["tile_fusion"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"BroadcastExchange HashedRelation", plan)


def test_greedy_in_all_groups_at_once():
    rng = np.random.default_rng(3)
    at = rng.integers(0, 20, (300, 2)).astype(float)
    boxes, group = np.hstack([at, at + rng.integers(0, 12, (300, 2))]), np.sort(rng.integers(0, 40, 300))
    want = []
    for i, (x, y, u, v) in enumerate(boxes):
        over = lambda j: (w := max(0, min(u, boxes[j][2]) - max(x, boxes[j][0])) * max(0, min(v, boxes[j][3]) - max(y, boxes[j][1]))) > 0 and w / ((u - x) * (v - y) + np.prod(boxes[j][2:] - boxes[j][:2]) - w) > 0.3  # noqa: B023, E731
        want += [] if any(group[j] == group[i] and over(j) for j in want) else [i]
    assert np.flatnonzero(suppress.kept_by_greedy(boxes, group, 0.3)).tolist() == want


@needs_tables
def test_sizes_write_a_row_a_detection(spark, shared):
    registry.queries()["eval_sizes"](spark, SF).collect()
    written = sum(f.stat().st_size for f in shared.rglob("*") if f.is_file())
    assert written < 40 * table(spark, SF, "pred").count()


@needs_tables
def test_masks_deal_out_no_pixel(spark):
    """Only labels, and what is counted of them, go through an exchange."""
    plan = registry.queries()["mask_iou_pairs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"Exchange hashpartitioning\([^)]*px", plan)


def test_written_leaves_no_shuffle_files(spark, shared):
    """Not even while a table made with the shuffle is held."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before, rows = files(), spark.range(1000).repartition(3, "id")
    got = written(rows)
    end = time.monotonic() + 5
    while (left := [f for f in files() - before if f.endswith(".data")]) and time.monotonic() < end:  # they are deleted beside what goes on
        time.sleep(0.1)
    assert not left and spark.conf.get(CLEANUP, None) in (None, "false")
    assert got.count() == rows.count() == 1000


@needs_tables
@pytest.mark.parametrize("name", ["mask_iou_pairs", "eval_segment_metrics"])
def test_masks_are_sorted_without_their_pixels(spark, name):
    """Lists of pixels are made of pairs that met; nothing below a join holds them."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        pred, gt = table(spark, SF, "pred"), table(spark, SF, "gt")
        rows = registry.queries()[name](spark, SF) if name == "mask_iou_pairs" else result_queries._mask_pairs(pred, gt)
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above, below = plan.split("SortMergeJoin", 1)
    assert "flatten(" in above and "flatten(" not in below


@needs_tables
@pytest.mark.parametrize("name", ["tracks_hidden", "tracks_table", "tracks_observation"])
def test_streams_are_dealt_out_once(spark, name):
    """No rank over a stream before its tracker."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "dense_rank" not in plan and plan.count("hashpartitioning(stream_id") == 1


@needs_tables
@pytest.mark.parametrize("name", ["eval_map", "eval_ap_by_class"])
def test_precision_keeps_no_shuffle_of_its_labels(spark, shared, name):
    """Once the ranked rows are written, what they were made of is gone from the disks: 22 bytes a label before."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f and f.endswith(".data")}
    size = lambda names: sum(Path(f).stat().st_size for f in names if Path(f).exists())
    before = files()
    query = registry.queries()[name](spark, SF)
    end = time.monotonic() + 5
    while (left := size(files() - before)) > 200_000 and time.monotonic() < end:
        time.sleep(0.2)
    assert left <= 200_000 and query.columns


@needs_tables
def test_labels_are_dealt_out_by_their_number(spark, shared, monkeypatch):
    """However few partitions a session has, a task sorts no more than its rows in memory: what it holds beyond that is spilled to its disk."""
    want, made = registry.queries()["eval_map"](spark, SF).collect(), []
    n, before = table(spark, SF, "gt").count(), spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(scans, "TASK_ROWS", 3000, raising=False)
    monkeypatch.setattr(ev, "written", lambda df: (made.append(df), written(df))[1])
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    try:
        query = registry.queries()["eval_map"](spark, SF)
        rows, points = (df._jdf.queryExecution().executedPlan().toString() for df in (made[0], query))
        assert query.collect() == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert set(re.findall(r"Exchange hashpartitioning\(l_orderkey#\d+L, (\d+)\), REPARTITION_BY_NUM", rows)) == {str(n // 3000)}
    assert re.search(rf"Exchange hashpartitioning\(cls#\d+, bucket#\d+L, {made[0].count() // 3000}\), REPARTITION_BY_NUM", points)


@needs_tables
def test_tracked_labels_are_dealt_out_by_their_number(spark, shared, monkeypatch):
    """The same before a tracker."""
    made, parts = [], int(spark.conf.get("spark.sql.shuffle.partitions")) + 1
    monkeypatch.setattr(scans, "TASK_ROWS", table(spark, SF, "gt").count() // parts)
    monkeypatch.setattr(augment_queries, "written", lambda df: (made.append(df), df)[1])
    registry.queries()["tracks_hidden"](spark, SF)
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    assert int(re.search(r"Exchange hashpartitioning\(l_orderkey#\d+L, (\d+)\), REPARTITION_BY_NUM", plan)[1]) >= parts
