"""Dataset descriptions, caches, sources, frames, crops and plug-ins."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.sources import datasets as ds
from tessera.sources import images


def test_coercion():
    assert [ds.coerce(x) for x in ("42", "3.5", "True", "none", "[1, 2]", "some text", "1e3")] == [42, 3.5, True, None, [1, 2], "some text", 1000.0]
    assert ds.pair("model = a.pt") == ("model", "a.pt") and ds.pair("a=b=c") == ("a", "b=c")
    with pytest.raises(ValueError, match="no value"):
        ds.pair("epochs=")


def test_descriptions(spark, tmp_path):
    pytest.importorskip("yaml")
    write = lambda text: (tmp_path / "d.yaml").write_text(text) and str(tmp_path / "d.yaml")
    found = ds.describe(write("path: set\ntrain: images/train\nvalidation: [a, b]\nnc: 2.0\nnames: [bus, car]\n"))
    assert found["names"] == {0: "bus", 1: "car"} and found["nc"] == 2 and found["channels"] == 3
    assert found["train"] == str(tmp_path / "set/images/train") and found["val"] == [str(tmp_path / "set/a"), str(tmp_path / "set/b")]
    assert ds.describe(write("train: a\nval: b\nnc: 3"))["names"] == {0: "class_0", 1: "class_1", 2: "class_2"}
    assert sorted(map(tuple, ds.classes(spark, found).collect())) == [(0, "bus"), (1, "car")]
    for text, match in (("val: b\nnc: 1", "no train"), ("train: a\nval: b", "neither"), ("train: a\nval: b\nnc: 1.5", "whole"), ("train: a\nval: b\nnc: 2\nnames: [x]", "1 names"), ("train: a\nval: b\nnames: {0: x, 5: y}", "numbered")):
        with pytest.raises(ValueError, match=match):
            ds.describe(write(text))
    with pytest.raises(ValueError, match="no test"):
        ds.describe(write("train: a\nval: b\nnc: 1"), "test")


def test_a_cache_is_read_for_the_same_listing_only(spark, tmp_path):
    files = spark.createDataFrame([("a", 1), ("b", 2)], "path string, length long")
    scan = lambda f: f.select("path", F.lit(1).alias("label"))
    at = f"file://{tmp_path}/cache"
    assert [ds.cached_scan(f, scan, at, v)[1] for f, v in ((files, "1"), (files.orderBy(F.desc("path")), "1"), (files, "2"), (files.where("path = 'a'"), "1"), (files, "1"))] == [False, True, False, False, True]
    assert ds.cached_scan(files, scan, at)[0].count() == 2


def test_kinds_of_source(spark):
    kinds = {"0": "camera", "screen 1": "screen", "rtsp://x/y": "stream", "a.streams": "stream", "l.txt": "list", "v.y4m": "video", "a/b.JPG": "image", "folder/x": "folder", "t.parquet": "table"}
    assert {k: ds.kind_of(k) for k in kinds} == kinds
    assert ds.kind_of(np.zeros((2, 2))) == "memory" and ds.kind_of(["a.jpg", "b.jpg"]) == "list" and ds.kind_of(spark.range(1)) == "table" and ds.kind_of([np.zeros((2, 2))]) == "memory"
    with pytest.raises(ValueError, match="device"):
        ds.load(spark, "0")


def y4m(frames, w, h):
    return f"YUV4MPEG2 W{w} H{h} F30:1 C420jpeg\n".encode() + b"".join(b"FRAME\n" + f.tobytes() + b"\x80" * (2 * ((w + 1) // 2) * ((h + 1) // 2)) for f in frames)


def test_lists_frames_and_extraction(spark, tmp_path):
    (tmp_path / "list.txt").write_text("./a.jpg\n\n/x/b.jpg\n./a.jpg\n")
    assert sorted(r.path.removeprefix("file:") for r in ds.load(spark, str(tmp_path / "list.txt")).collect()) == sorted([f"{tmp_path}/a.jpg", "/x/b.jpg"])
    pixels = np.random.default_rng(0).integers(0, 256, (10, 5, 7), np.uint8)
    (tmp_path / "v").mkdir()
    for name, n in (("a", 10), ("b", 4)):
        (tmp_path / f"v/{name}.y4m").write_bytes(y4m(pixels[:n], 7, 5))
    rows = ds.load(spark, str(tmp_path / "v/a.y4m"), stride=4).orderBy("frame").collect()
    assert [r.frame for r in rows] == [1, 5, 9] and all(bytes(r.pixels) == pixels[r.frame - 1].tobytes() for r in rows)
    frames = ds.video_frames(spark.read.format("binaryFile").load(str(tmp_path / "v")))
    assert [(r.name, r.path[-5:], r.frame) for r in ds.extracted(frames, 3, 4).orderBy("name").collect()] == [("0001", "a.y4m", 1), ("0002", "a.y4m", 4), ("0003", "a.y4m", 7), ("0004", "a.y4m", 10), ("0005", "b.y4m", 1), ("0006", "b.y4m", 4)]
    with pytest.raises(ValueError, match="damaged"):
        list(ds.y4m_frames(y4m(pixels, 7, 5)[:-3]))
    with pytest.raises(ValueError, match="not a y4m"):
        list(ds.y4m_frames(b"\0"))


def test_streams_side_by_side(spark, tmp_path):
    for k in (1, 2):
        spark.createDataFrame([(f,) for f in range(1, 8)], "frame int").coalesce(1).write.parquet(f"{tmp_path}/s{k}")
    rows = ds.read_streams(spark, {1: f"{tmp_path}/s1", 2: f"{tmp_path}/s2"}, "frame int", stride=3)
    query = rows.writeStream.format("memory").queryName("side").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("side").select("stream_id", "frame").collect()) == [(k, f) for k in (1, 2) for f in (1, 4, 7)]


def test_runs_and_trials(spark, tmp_path):
    (tmp_path / "r.csv").write_text("epoch,  map50 , loss\n1, 0.5, 2\n2, 0.6, 1\n")
    assert [tuple(r) for r in ds.read_run(spark, str(tmp_path / "r.csv")).collect()] == [(1, 0.5, 2), (2, 0.6, 1)]
    ds.add_epoch(spark, f"{tmp_path}/run", {"epoch": 1, "a": 0.5})
    rows = {r.epoch: r.asDict() for r in ds.add_epoch(spark, f"{tmp_path}/run", {"epoch": 2, "b": 0.25}).collect()}
    assert rows[1]["b"] is None and rows[2]["a"] is None and rows[2]["b"] == 0.25
    (tmp_path / "t.ndjson").write_text('{"fitness": 0.1, "lr": 0.5, "n": 3}\n{"fitness": 0.9, "lr": 0.1, "n": 5}\n')
    trials = ds.read_trials(spark, str(tmp_path / "t.ndjson"))
    assert trials.first().fitness == 0.9
    space = {"lr": (0.0, 1.0), "n": (1.2, 9.8)}
    made = [ds.mutate(trials, space, seed, whole=("n",)) for seed in range(30)]
    assert all(0 <= m["lr"] <= 1 and m["n"] in range(2, 10) for m in made) and len({m["lr"] for m in made}) > 10 and abs(np.median([m["n"] for m in made]) - 5) <= 2
    assert ds.mutate(trials, space, 3) == ds.mutate(trials, space, 3)
    with pytest.raises(ValueError, match="whole number"):
        ds.constrain({"n": 1}, {"n": (1.2, 1.8)}, ("n",))
    table = ds.benchmark_table(spark.createDataFrame([("b", 1.0, None, None), ("c", 2.0, 0.5, 4.0)], "format string, size_mb double, metric double, ms double")).collect()
    assert [(r.format, r.fps) for r in table] == [("c", 250.0), ("b", None)]


def test_crops_saves_and_embeddings(spark):
    image = np.arange(100 * 80 * 3, dtype=np.uint32).astype(np.uint8).reshape(80, 100, 3)
    frames = ds.from_arrays(spark, [image]).withColumn("image_id", F.lit(1).cast("long"))
    pred = spark.createDataFrame([(1, 0, 2, 10.0, 20.0, 50.0, 60.0), (1, 1, 3, 120.0, 20.0, 180.0, 60.0)], "image_id long, det_id int, cls int, x1 double, y1 double, x2 double, y2 double")
    got = {r.det_id: r for r in ds.crops(frames, pred, 1.0, 0).collect()}
    assert bytes(got[0].pixels) == image[20:60, 10:50].tobytes() and got[0].cls == 2 and got[1].pixels is None
    rows = {r.det_id: r.embedding for r in ds.embed(ds.crops(frames, pred, 1.0, 0), lambda: lambda a: a.mean((0, 1))).collect()}
    assert rows[0] == pytest.approx(image[20:60, 10:50].mean((0, 1)).tolist()) and rows[1] is None
    doubled = ds.predict(spark.range(10), lambda: lambda pdf: pd.DataFrame({"id": pdf["id"] * 2}), "id long")
    assert sorted(r.id for r in doubled.collect()) == list(range(0, 20, 2))
    saves = spark.createDataFrame([("blur", f"i{i % 4}", i) for i in range(12)] + [("weather", "i0", 0)], "branch string, image string, n int")
    assert sorted((r.branch, r.image, r.n) for r in ds.capped(saves, ["branch", "image"], "branch", 3, ["n"]).collect()) == [("blur", "i0", 0), ("blur", "i1", 1), ("blur", "i2", 2), ("weather", "i0", 0)]
    assert ds.capped(saves, ["branch", "image"], "branch", -1, ["n"]).count() == 5


def test_pairs_and_readable_files(spark, tmp_path):
    for sub in ("images", "labels"):
        (tmp_path / sub).mkdir()
    png = lambda w, h: images.encode_depth(np.ones((h, w)))
    for name, a, b in (("ok", png(20, 30), png(20, 30)), ("size", png(20, 30), png(30, 20)), ("bad", png(20, 30), b"no image"), ("lone", png(20, 30), None)):
        (tmp_path / f"images/{name}.png").write_bytes(a)
        if b:
            (tmp_path / f"labels/{name}.png").write_bytes(b)
    read = lambda sub: spark.read.format("binaryFile").load(f"{tmp_path}/{sub}")
    got = {r.path.rsplit("/")[-1]: r.status for r in ds.verified_pairs(read("images"), read("labels")).collect()}
    assert got == {"ok.png": "found", "size.png": "other size", "bad.png": "unreadable", "lone.png": "missing"}
    files, n = ds.readable(read("labels"))
    assert files.count() == 2 and n == {"found": 2, "corrupt": 1}
    depth = np.array([[0.5, 2.25]])
    assert np.allclose(ds.from_depth(ds.npy(depth)), depth) and np.allclose(ds.from_depth(images.encode_depth(depth)), depth)
    assert ds.check_count(files, 2) is files
    with pytest.raises(ValueError, match="2 instances, not 3"):
        ds.check_count(files, 3)
    assert ds.probe([str(tmp_path / "images/ok.png")])["mb_s"] > 0


def test_plug_ins_and_logs(spark):
    tasks, log = ds.Tasks(), []
    tasks.register("detect", "transform", ds.compose(lambda r: r.where("id > 2"), lambda r: r.withColumn("x", F.col("id") * 2)))

    @tasks.register("detect", "verify")
    def verify(rows):
        return rows.where("id < 4")

    tasks.on("before transform", lambda rows: log.append(rows.columns))
    tasks.on("after transform", lambda rows: rows.drop("id"))
    assert sorted(r.x for r in tasks.run("detect", "transform", spark.range(5)).collect()) == [6, 8] and log == [["id"]]
    assert tasks.run("detect", "verify", spark.range(9)).count() == 4
    with pytest.raises(KeyError, match="validate"):
        tasks.run("detect", "validate", spark.range(1))
    lines = spark.createDataFrame([("a", i, x) for i, x in enumerate(["p", "p", None, None, "p", "q"])] + [("b", 0, "p")], "source string, n int, line string")
    assert [tuple(r) for r in ds.condensed(lines).orderBy("source", "run").collect()] == [("a", 1, "p", 2), ("a", 2, None, 2), ("a", 3, "p", 1), ("a", 4, "q", 1), ("b", 1, "p", 1)]
