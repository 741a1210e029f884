from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import tracks
from tessera.streaming import counters, kalman, tracker
from tessera.streaming.assign import hungarian, match

SCHEMA = "stream_id long, frame int, det_id int, cls int, conf double, x1 double, y1 double, x2 double, y2 double"


def frames(n=8, weak_from=4):
    rows = []
    for f in range(1, n + 1):
        for k, (x, y) in enumerate([(100, 100), (300, 100), (500, 300)]):
            score = 0.2 if k == 2 and f >= weak_from else 0.9
            rows.append((7, f, k, k, score, x + 4.0 * f, float(y), x + 4.0 * f + 60, y + 80.0))
    return rows


def test_assignment_is_optimal():
    r = np.random.default_rng(0)
    for n in (1, 2, 4, 6):
        cost = r.random((n, n))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(n)))
        assert cost[np.arange(n), hungarian(cost)].sum() == pytest.approx(best)
    assert match(np.array([[0.9, 0.2], [0.1, 0.95]]), 0.5) == [(0, 1), (1, 0)]
    assert match(np.array([[0.9]]), 0.5) == [] and match(np.zeros((0, 3)), 1) == []


def test_kalman_follows_a_steady_box():
    at = lambda f: kalman.to_measure(np.array([[f * 5.0, 10, f * 5.0 + 40, 90]]))
    mean, cov = kalman.start(at(0))
    for f in range(1, 30):
        mean, cov = kalman.predict(mean, cov)
        assert kalman.gate(mean, cov, at(f))[0, 0] < 9.5 or f < 3
        mean, cov = kalman.update(mean, cov, at(f))
    assert mean[0, 4] == pytest.approx(5, abs=0.2) and np.allclose(kalman.to_box(mean), [[145, 10, 185, 90]], atol=1)


def test_tracker_keeps_ids_through_weak_frames(spark):
    got = tracker.track_table(spark.createDataFrame(frames(), SCHEMA)).toPandas()
    assert got.groupby("det_id")["track_id"].nunique().tolist() == [1, 1, 1] and got["track_id"].nunique() == 3
    assert len(got) == 24 and set(got[got.frame == 1].track_id) == {1, 2, 3}


def test_tracker_forgets_confirms_and_drops_degenerate(spark):
    rows = [(1, 1, 0, 0, 0.9, 0.0, 0.0, 50.0, 50.0), (1, 2, 0, 0, 0.9, 0.0, 0.0, 50.0, 50.0), (1, 2, 1, 0, 0.9, 300.0, 0.0, 350.0, 50.0), (1, 2, 2, 0, 0.9, 10.0, 10.0, 10.0, 40.0), (1, 3, 1, 0, 0.9, 300.0, 0.0, 350.0, 50.0), (1, 60, 0, 0, 0.9, 0.0, 0.0, 50.0, 50.0), (1, 61, 0, 0, 0.9, 0.0, 0.0, 50.0, 50.0)]
    got = {(r.frame, r.det_id): r.track_id for r in tracker.track_table(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, 0] == got[2, 0] and (2, 1) not in got and (3, 1) in got and (2, 2) not in got
    assert (60, 0) not in got and got[61, 0] not in (got[1, 0], got[3, 1])


def test_tracker_as_a_stream(spark, tmp_path):
    source, want = tmp_path / "in", tracker.track_table(spark.createDataFrame(frames(), SCHEMA)).toPandas()
    frame = spark.createDataFrame(frames(), SCHEMA)
    for k in range(2):
        frame.where(f"(frame - 1) div 4 = {k}").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(source))
    query = tracker.track_stream(stream).writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = spark.table("tracked").toPandas()
    key = ["frame", "det_id"]
    assert got.sort_values(key)[["frame", "det_id", "track_id"]].values.tolist() == want.sort_values(key)[["frame", "det_id", "track_id"]].values.tolist()


def test_line_counter_as_a_stream_equals_the_table(spark, tmp_path):
    line = [(430.0, 0.0), (430.0, 480.0)]
    rows = [(1, f + 1, float(x), 240.0) for f, x in enumerate((428, 436, 444, 436, 428, 420, 412))] + [(2, f + 1, float(x), 240.0) for f, x in enumerate((500, 450, 420))] + [(3, 1, 10.0, 10.0)]
    points = spark.createDataFrame(rows, "track_id long, frame int, x double, y double")
    want = {tuple(r) for r in tracks.line_crossings(points, line).collect()}
    assert want == {(1, 2, "in"), (2, 3, "out")}
    points.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    query = counters.line_counter(stream, line).writeStream.format("memory").queryName("lines").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("lines").collect()} == want


def test_windowed_counts(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) as ts, if(id % 2 = 0, 'a', 'b') as cls, cast(id as double) as x, 5.0d as y from range(40)").write.parquet(str(tmp_path / "in"))
    schema = "ts timestamp, cls string, x double, y double"
    for name, frame in (("w1", counters.windowed_counts), ("w2", lambda s: counters.region_windows(s, {"left": [(0.0, 0.0), (10.5, 0.0), (10.5, 10.0), (0.0, 10.0)]}))):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = frame(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("complete").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    assert spark.table("w1").selectExpr("sum(n)").first()[0] == 40 and spark.table("w1").count() == 8
    assert spark.table("w2").selectExpr("sum(n)").first()[0] == 10


def track_ids(rules, frames, camera=None):
    """Ids by frame of the tracks over frames of boxes (x1, y1, x2, y2, score)."""
    memory, out = tracker.Memory(), []
    for f, rows in enumerate(frames, 1):
        if rows:
            at = np.array(rows, float)
            warp = camera[f] if camera and f in camera else None
            found = tracker.advance(memory, at[:, :4], at[:, 4], np.zeros(len(at), int), f, rules, warp)
            out.append({t.id: d for t, d in found})
            memory = tracker.Memory.load(memory.dump())  # what a stream keeps is enough
    return out


def walker(f, x0=0.0, speed=5.0, score=0.9):
    return (x0 + speed * f, 10, x0 + speed * f + 40, 90, score)


@pytest.mark.parametrize("rules", [tracker.BYTE, tracker.BOT, tracker.OC, tracker.FAST])
def test_trackers_hold_two_walkers(rules):
    frames = [[walker(f), walker(f, 300, -3)] for f in range(20)]
    ids = track_ids(rules, frames)
    assert all(i == {1: 0, 2: 1} for i in ids)


@pytest.mark.parametrize("rules", [tracker.BYTE, tracker.BOT, tracker.OC, tracker.FAST])
def test_trackers_ignore_empty_boxes(rules):
    frames = [[walker(f), (5, 5, 5, 20, 0.9), (50, 50, 40, 60, 0.2)] for f in range(5)]
    assert all(list(i) == [1] for i in track_ids(rules, frames))


def test_weak_detections_keep_a_track_except_without_the_second_step():
    frames = [[walker(f, score=0.2 if f in (6, 7) else 0.9)] for f in range(12)]
    assert [len(i) for i in track_ids(tracker.BYTE, frames)] == [1] * 12
    assert [len(i) for i in track_ids(tracker.OC, frames)][6:8] == [0, 0] and track_ids(tracker.OC, frames)[-1] == {1: 0}


def test_camera_motion_is_undone():
    """All moves 200 pixels at once: without the camera's motion the tracks are new ones."""
    frames = [[walker(f, 0 if f < 8 else 200), walker(f, 300 if f < 8 else 500, 2)] for f in range(14)]
    shift = {9: np.array([[1, 0, 200], [0, 1, 0]], float)}
    assert track_ids(tracker.BOT, frames, shift)[-1] == {1: 0, 2: 1}
    assert track_ids(tracker.BOT, frames)[-1] != {1: 0, 2: 1}


def test_directions_tell_crossing_walkers_apart():
    t = tracker.Track(1, "tracked", 0.9, 0, 1, 4, [0.0] * 8, np.eye(8).tolist(), seen=[[1, 0, 0, 10, 10], [2, 5, 0, 15, 10], [4, 15, 0, 25, 10]])
    cost = tracker.turns([t], np.array([[25, 0, 35, 10], [5, 0, 15, 10], [15, 20, 25, 30], [15, 0, 25, 10]], float), 3)
    assert cost[0] == pytest.approx([0, 1, 0.5, 0])


def test_state_is_rebuilt_after_a_gap():
    """A walker that speeds up while unseen: the rebuilt speed is the one over the gap."""
    frames = [[walker(f)] for f in range(6)] + [[]] * 5 + [[(25 + 7 * 6, 10, 65 + 7 * 6, 90, 0.9)]]
    ends = {}
    for name, rules in (("plain", tracker.Rules(first=0.99)), ("rebuilt", tracker.Rules(first=0.99, rebuild=True))):
        memory = tracker.Memory()
        for f, rows in enumerate(frames, 1):
            if rows:
                at = np.array(rows, float)
                tracker.advance(memory, at[:, :4], at[:, 4], np.zeros(1, int), f, rules)
        ends[name] = [t.mean[4] for t in memory.tracks if t.id == 1][0]
        assert len(memory.tracks) == 1
    assert ends["plain"] < ends["rebuilt"] < 7


def test_hidden_tracks_wait_and_no_track_starts_on_another():
    wall = (60, 0, 160, 100, 0.95)
    frames = [[wall, walker(f, 20, 5)] for f in range(9)] + [[wall]] * 8 + [[wall, (66, 10, 106, 90, 0.9)]]
    memory, states = tracker.Memory(), []
    for f, rows in enumerate(frames, 1):
        at = np.array(rows, float)
        tracker.advance(memory, at[:, :4], at[:, 4], np.zeros(len(at), int), f, tracker.FAST)
        states.append({t.id: t.state for t in memory.tracks})
    assert states[12][2] == "tracked" and {t.id for t in memory.tracks} == {1, 2}
    twice = [[wall, (61, 0, 161, 100, 0.9)] for _ in range(4)]
    assert [len(i) for i in track_ids(tracker.FAST, [[wall], *twice])] == [1] * 5 and max(len(i) for i in track_ids(tracker.BYTE, [[wall], *twice])) == 2


def streamed(spark, tmp_path, rows, schema, make, name):
    for i, part in enumerate((rows[::2], rows[1::2]) if name == "unordered" else (rows[: len(rows) // 2], rows[len(rows) // 2 :])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in{i}")
    points = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/in*")
    query = make(points).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted(tuple(r) for r in spark.table(name).collect())


def test_streams_give_the_tables_rows(spark, tmp_path):
    from tessera.operators import tracks
    from tessera.streaming import counters

    r = np.random.default_rng(4)
    schema = "track_id long, frame int, x double, y double, value double"
    rows = [(t, f, float(x), float(y), float(v)) for f in range(1, 13) for t, x, y, v in zip(range(20), r.integers(0, 640, 20), r.integers(0, 480, 20), r.integers(0, 60, 20), strict=True)]
    table = spark.createDataFrame(rows, schema)
    region = [(220.0, 140.0), (420.0, 140.0), (420.0, 340.0), (220.0, 340.0)]
    want = sorted(tuple(x) for x in tracks.region_entries(table, region).collect())
    assert streamed(spark, tmp_path, rows, schema, lambda p: counters.polygon_counter(p, region), "polygons") == want and len(want) > 10
    want = sorted(tuple(x) for x in tracks.speeds(table).collect())
    assert streamed(spark, tmp_path, rows, schema, counters.speed_stream, "speeds") == want and len(want) == 20
    reps = tracks.stage_repetitions(table, F.col("value"), 40.0, 10.0).groupBy("track_id").agg(F.max("reps").alias("n")).where("n > 0")
    want = {x.track_id: x.n for x in reps.collect()}
    got = streamed(spark, tmp_path, rows, schema, lambda p: counters.repetition_stream(p, "value", 40.0, 10.0), "reps")
    assert {t: max(n for u, _, n in got if u == t) for t, _, _ in got} == want


@pytest.mark.parametrize("rules", [tracker.BYTE, tracker.BOT, tracker.OC, tracker.FAST])
def test_frames_without_hits_are_passed_over(rules, monkeypatch):
    """Scattered boxes with a walker now and then, missing frames, batches that end anywhere: as frame by frame, with the tracker run for few of them."""
    r = np.random.default_rng(7)
    rows = [(f, d, 0, float(r.random()), *(at := r.integers(0, 4000, 2)), *(at + r.integers(20, 200, 2))) for f in range(1, 900) if f % 90 < 80 for d in range(r.integers(1, 5))]
    rows += [(f, 9, 1, 0.2 if f % 100 == 5 else 0.9, *walker(f % 100, 100.0 + f, 6.0)[:4]) for f in range(1, 900) if f % 100 < 12 and f % 100 != 8 and f % 90 < 80]
    pdf = pd.DataFrame(rows, columns=["frame", "det_id", "cls", "conf", "x1", "y1", "x2", "y2"]).sort_values(["frame", "det_id"])
    plain, want = tracker.Memory(), []
    for frame, part in pdf.groupby("frame"):
        at = part[["x1", "y1", "x2", "y2"]].to_numpy(float)
        found = tracker.advance(plain, at, part["conf"].to_numpy(), part["cls"].to_numpy(), int(frame), rules)
        want += [(int(frame), t.id, int(part["det_id"].iloc[d]), *kalman.to_box(np.array(t.mean), rules.form)) for t, d in found]
    calls, real, memory = [], tracker.advance, tracker.Memory()
    monkeypatch.setattr(tracker, "advance", lambda m, *rest: (calls.append(rest[3]), real(m, *rest))[1])
    parts = []
    for low in range(0, 900, 300):
        parts.append(tracker.run_frames(memory, 1, pdf[(pdf["frame"] >= low) & (pdf["frame"] < low + 300)], rules))
        memory = tracker.Memory.load(memory.dump())
    got = [tuple(x) for p in parts for x in p[["frame", "track_id", "det_id", "x1", "y1", "x2", "y2"]].itertuples(index=False)]
    assert [x[:3] for x in got] == [x[:3] for x in want] and len(want) > 50
    assert np.allclose(np.array(got)[:, 3:], np.array(want)[:, 3:])
    assert (memory.next_id, memory.frame, [t.id for t in memory.tracks]) == (plain.next_id, plain.frame, [t.id for t in plain.tracks])
    assert len(calls) < pdf["frame"].nunique() / 2


@pytest.mark.parametrize("rows", [1, 7, 10_000])
def test_frames_are_counted_as_they_come(spark, rows):
    """Images in place of frames, their numbers far apart, in batches of any size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        want = tracker.track_table(spark.createDataFrame(frames(), SCHEMA)).toPandas()
        apart = spark.createDataFrame(frames(), SCHEMA).withColumn("frame", F.col("frame").cast("long") * F.col("frame") * 1_000_000_007)
        got = tracker.track_table(apart, counted=True).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    key = ["frame", "det_id"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True))


@pytest.mark.parametrize("form", ["xyah", "xywh"])
@pytest.mark.parametrize("turned", [False, True])
def test_one_track_follows_as_many_do(form, turned):
    r = np.random.default_rng(2)
    boxes = np.cumsum(r.random((12, 2)) * 6, 0)
    boxes = kalman.to_measure(np.hstack([boxes, boxes + 30 + r.random((12, 2)) * 9]), form)
    mean, cov = kalman.start(boxes[:1], form)
    if turned:
        mean, cov = kalman.warp(mean, cov, np.array([[0.9, -0.2, 5], [0.3, 0.8, 2]]))
    got = kalman.follow(mean[0], cov[0], boxes[1:], form)
    for z in boxes[1:]:
        mean, cov = kalman.update(*kalman.predict(mean, cov, form), z[None], form)
    assert np.allclose(got[0], mean[0], rtol=1e-9) and np.allclose(got[1], cov[0], rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("form", ["xyah", "xywh"])
def test_plain_floats_are_the_arrays_filter(form):
    r = np.random.default_rng(6)
    boxes = r.random((9, 2)) * 50
    boxes = np.hstack([boxes, boxes + 20 + r.random((9, 2)) * 40])
    other = np.vstack([boxes[::-1] + 5, [[9, 9, 9, 30], [40, 40, 20, 20], [500, 500, 510, 510]]])
    measures = kalman.to_measure(boxes, form)
    mean, cov = kalman.start(measures, form)
    for _ in range(3):
        one = [kalman.predict_one(m, c, form) for m, c in zip(mean.tolist(), cov.tolist(), strict=True)]
        mean, cov = kalman.predict(mean, cov, form)
        assert np.allclose([m for m, _ in one], mean, rtol=1e-12) and np.allclose([c for _, c in one], cov, rtol=1e-12)
        assert np.allclose([kalman.box_of(m, form) for m, _ in one], kalman.to_box(mean, form), rtol=1e-12) and all(kalman.alone(c) for _, c in one)
        mean, cov = kalman.update(mean, cov, measures + 2, form)
    assert [kalman.measure_of(b, form) for b in boxes.tolist()] == measures.tolist()
    began = [kalman.start_one(m, form) for m in measures.tolist()]
    assert np.array_equal([m for m, _ in began], kalman.start(measures, form)[0]) and np.allclose([c for _, c in began], kalman.start(measures, form)[1], rtol=1e-12)
    assert not kalman.alone(kalman.warp(mean, cov, np.array([[0.9, -0.2, 5], [0.3, 0.8, 2]]))[1][0].tolist())
    few = tracker.overlaps(boxes[:3].tolist(), other.tolist())
    assert np.allclose(few, tracker.overlap(boxes[:3], other)) and np.allclose(tracker.overlaps(boxes.tolist(), other.tolist()), tracker.overlap(boxes, other)) and len(boxes) * len(other) > tracker.FEW


@pytest.mark.parametrize("rules", [tracker.BYTE, tracker.OC, tracker.FAST])
def test_frames_of_few_boxes_make_no_arrays_of_states(rules, monkeypatch):
    """Only hits do: arrays of a few tracks take ten times as long as plain floats."""
    for name in ("predict", "start", "to_measure"):
        monkeypatch.setattr(kalman, name, lambda *a, name=name: pytest.fail(name))
    memory, r = tracker.Memory(), np.random.default_rng(1)
    for f in range(1, 40):
        at = r.integers(0, 100_000, (4, 2)).astype(float)
        tracker.advance(memory, np.hstack([at, at + 30]), np.full(4, 0.9), np.zeros(4, int), f, rules)
    assert memory.frame == 39 and memory.next_id == 4 * 39 + 1
