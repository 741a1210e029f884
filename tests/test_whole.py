"""Queries take all rows of their tables, not a subset."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest

from tessera.operators import tracks
from tessera.plans import registry
from tessera.plans.canonical import table
from tessera.streaming import assign, tracker

SF = os.environ.get("TESSERA_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def sorted_rows(frame: pd.DataFrame, *by: str) -> pd.DataFrame:
    return frame.sort_values(list(by)).reset_index(drop=True)


@pytest.fixture(scope="module")
def con():
    con = pytest.importorskip("duckdb").connect()
    for t in ("orders", "lineitem", "events"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def same_without(spark, con, name: str, cut: str, times: int, *by: str) -> pd.DataFrame:
    """The query's rows, once they equal those of its SQL with ``cut`` left out."""
    sql = registry.oracle_sql()[name]
    assert sql.count(cut) in (0, times)
    got, want = registry.queries()[name](spark, SF).toPandas(), con.sql(sql.replace(cut, "")).df()
    pd.testing.assert_frame_equal(sorted_rows(got[list(want.columns)], *by), sorted_rows(want, *by), check_dtype=False, rtol=0, atol=0)
    return got


def test_tracks_over_all_detections(spark):
    """Each stream in one go outside Spark, against the query with batches that cut through frames."""
    pred = table(spark, SF, "pred").toPandas()
    pred["stream_id"] = pred["image_id"] % 4
    pred["frame"] = pred.groupby("stream_id")["image_id"].rank(method="dense").astype(int)
    want = pd.concat([tracker.run_frames(tracker.Memory(), k, rows, tracker.Rules()) for k, rows in pred.groupby("stream_id")])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = registry.queries()["tracks_table"](spark, SF).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    key = ["stream_id", "frame", "track_id"]
    pd.testing.assert_frame_equal(sorted_rows(got, *key), sorted_rows(want, *key), check_dtype=False)
    assert got["frame"].max() > 300


def test_assignment_without_hopeless_rows_and_columns():
    r = np.random.default_rng(1)
    for _ in range(300):
        cost, limit = r.random(r.integers(1, 7, 2)), r.random()
        n, m = cost.shape
        square = np.full((n + m, n + m), limit / 2)
        square[:n, :m] = np.where(cost > limit, 1e6, cost)
        square[n:, m:] = 0
        to = assign.hungarian(square)[:n]
        assert assign.match(cost, limit) == [(i, j) for i, j in enumerate(to) if j < m and cost[i, j] <= limit]


def test_crop_layers_over_all_images(spark, con):
    got = same_without(spark, con, "crop_layers", " where image_id < 200", 2, "image_id", "layer", "x0", "y0")
    assert got["image_id"].nunique() == table(spark, SF, "images").count() and (got.groupby("image_id").size() == 21).all()


def test_early_stopping_over_all_tracks(spark, con):
    got = same_without(spark, con, "early_stopping", " where track_id < 20", 1, "track_id", "frame")
    assert len(got) == table(spark, SF, "points").count()


def test_mask_iou_over_all_images(spark, con):
    got = same_without(spark, con, "mask_iou_pairs", " where image_id % 3 = 0", 2, "image_id", "a", "b")
    assert set(got["image_id"] % 3) == {0, 1, 2}


def test_heatmap_over_all_boxes(spark, con):
    got = same_without(spark, con, "track_heatmap", " where gt_id = 1", 1, "px", "py")
    first = table(spark, SF, "gt").where("gt_id = 1")
    assert got["heat"].sum() > 2 * tracks.heatmap(first, 50).agg({"heat": "sum"}).first()[0]


def test_least_rectangles_of_all_boxes(spark, con):
    got = same_without(spark, con, "least_rectangles", " where gt_id = 1", 1, "image_id", "longer", "shorter", "cx")
    keys = table(spark, SF, "gt").select("image_id", "gt_id").toPandas()
    pd.testing.assert_frame_equal(sorted_rows(got[["image_id", "gt_id"]], "image_id", "gt_id"), sorted_rows(keys, "image_id", "gt_id"))
