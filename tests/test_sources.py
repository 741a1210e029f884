from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import annotations, images, labels


@pytest.fixture
def files(spark):
    texts = {
        "a": "1 0.5 0.5 0.2 0.2\n0 0.4 0.4 0.1 0.1\n",
        "dup": "2 0.5 0.5 0.2 0.2\n0 0.4 0.4 0.1 0.1\n2 0.5 0.5 0.2 0.2",
        "seg": "0 0.1 0.1 0.3 0.1 0.3 0.5",
        "mixed": "0 0.1 0.1 0.3 0.1 0.3 0.5\n1 0.5 0.5 0.2 0.2",
        "high": "0 0.5 0.5 1.02 0.1", "low": "0 -0.02 0.5 0.1 0.1", "near": "0 1.01 0.5 0.1 -0.01",
        "class": "6 0.5 0.5 0.1 0.1", "word": "0 x 0.5 0.1 0.1", "short": "0 0.5 0.5 0.1", "empty": " \n", "null": None,
    }
    return spark.createDataFrame(list(texts.items()), "path string, value string")


def test_label_files(files):
    got = {r.path: r for r in labels.parse(files, 6).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "found", "dup": "found", "seg": "found", "mixed": "corrupt", "high": "corrupt", "low": "corrupt", "near": "found", "class": "corrupt", "word": "corrupt", "short": "corrupt", "empty": "empty", "null": "empty"}
    assert [r[0] for r in got["a"].rows] == [1, 0] and [r[0] for r in got["dup"].rows] == [0, 2] and got["mixed"].rows == []
    boxes = {(r.path, r.box_id): r for r in labels.boxes(labels.parse(files, 6)).collect()}
    assert (boxes["seg", 0].cx, boxes["seg", 0].cy) == pytest.approx((0.2, 0.3)) and (boxes["seg", 0].w, boxes["seg", 0].h) == pytest.approx((0.2, 0.4)) and len(boxes["seg", 0].points) == 3
    assert boxes["a", 0].cls == 1 and boxes["a", 0].points is None


def test_label_paths_scan_and_counters(spark, tmp_path):
    (tmp_path / "labels/train").mkdir(parents=True)
    (tmp_path / "labels/train/x.txt").write_text("0 0.5 0.5 0.1 0.1")
    (tmp_path / "labels/train/y.txt").write_text("9 0.5 0.5 0.1 0.1")
    im = spark.createDataFrame([(f"file://{tmp_path}/images/train/{n}.jpg",) for n in "xyz"] , "im_file string")
    scanned = labels.scan(spark, f"{tmp_path}/labels").withColumn("path", F.regexp_replace("path", "^file:/+", "file:///"))
    assert labels.counters(im, labels.parse(scanned, 6)).first().asDict() == {"found": 1, "missing": 1, "empty": 0, "corrupt": 1}
    assert spark.range(1).select(labels.label_path(F.lit("/d/images/images/a.b.png"))).first()[0] == "/d/images/labels/a.b.txt"


def test_label_lines_round_trip(spark):
    rows = spark.createDataFrame([(1, 0, 2, 0.5, 0.25, 0.125, 0.0625), (1, 1, 3, 0.1, 0.2, 0.3, 0.4), (2, 0, 0, 0.3, 0.3, 0.2, 0.2)], "image_id long, gt_id int, cls int, cx double, cy double, w double, h double")
    text = {r.image_id: r.text for r in labels.lines(rows, "image_id", ["gt_id"]).collect()}
    assert text[1] == "2 0.500000 0.250000 0.125000 0.0625000\n3 0.100000 0.200000 0.300000 0.400000"
    back = labels.boxes(labels.parse(labels.lines(rows, "image_id", ["gt_id"]).select(F.col("image_id").cast("string").alias("path"), F.col("text").alias("value")), 6))
    assert sorted((int(r.path), r.box_id, r.cls, r.cx, r.cy, r.w, r.h) for r in back.collect()) == sorted(tuple(r) for r in rows.collect())


def test_coco_and_grounding(spark, tmp_path):
    doc = {"images": [{"id": 1, "width": 100, "height": 50, "file_name": "1.jpg", "caption": "A red car and a Dog"}], "categories": [{"id": 1, "name": "car"}],
           "annotations": [{"id": k, "image_id": 1, "category_id": c, "bbox": b, "iscrowd": w, "tokens_positive": t} for k, c, b, w, t in [(1, 1, [10, 10, 20, 20], 0, [[2, 9]]), (2, 1, [10, 10, 20, 20], 0, [[16, 19]]), (3, 1, [0, 0, 0, 5], 0, [[2, 5]]), (4, 1, [0, 0, 5, 5], 1, [[2, 5]]), (5, 2, [10, 10, 20, 20], 0, [[2, 5], [6, 9]])]]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    read = annotations.read_coco(spark, str(tmp_path / "a.json"))
    got = sorted((r.cls, r.cx, r.cy, r.w, r.h) for r in annotations.coco_boxes(read).collect())
    assert got == [(0, 0.2, 0.4, 0.2, 0.4), (1, 0.2, 0.4, 0.2, 0.4)]
    assert [tuple(r) for r in annotations.coco_names(read).collect()] == [(0, "car")]
    assert sorted((r.cls, r.text) for r in annotations.grounding_boxes(read).collect()) == [(0, "red car"), (0, "red car"), (1, "dog")]


def test_records(spark, tmp_path):
    lines = [{"type": "dataset", "task": "detect", "class_names": {"0": "car"}}, *[{"type": "image", "file": f"{i}.jpg", "split": "train", "annotations": {"boxes": [[0, 0.5, 0.5, 0.1, 0.1]], "pose": [[0, 0.5, 0.5, 0.1, 0.1, 0.2, 0.2, 2, 0.3, 0.3, 1]]}} for i in range(12)]]
    (tmp_path / "d.ndjson").write_text("\n".join(map(json.dumps, lines)))
    records = annotations.read_records(spark, str(tmp_path / "d.ndjson"))
    assert annotations.record_boxes(records).count() == 12
    assert annotations.auto_validation(records).where("split = 'val'").count() == 1
    mixed = records.where("type = 'image'").withColumn("split", F.when(F.regexp_extract("file", "[0-9]+", 0).cast("int") < 4, "train").otherwise("test"))
    split = {r.file: r.split for r in annotations.auto_validation(mixed).collect()}
    assert len(split) == 12 and sorted(split.values()) == ["test"] * 8 + ["train"] * 3 + ["val"]
    assert annotations.auto_validation(mixed.withColumn("split", F.when(F.col("file") == "1.jpg", "val").otherwise("train"))).where("split = 'val'").count() == 1
    for left in (mixed.where("split = 'test'"), mixed.where("file = '1.jpg'")):
        with pytest.raises(ValueError, match="training image"):
            annotations.auto_validation(left)
    assert annotations.keypoint_shape(annotations.record_boxes(records, "pose")) == (2, 3)
    with pytest.raises(ValueError, match="no length"):
        annotations.keypoint_shape(annotations.record_boxes(records, "boxes"))


def test_prediction_json(spark):
    rows = spark.createDataFrame([("d/0042.jpg", 3, 1.00049, 2.0, 11.0, 22.0, 0.123456), ("d/x1.jpg", 0, 0.0, 0.0, 1.0, 1.0, 0.5)], "file_name string, cls int, x1 double, y1 double, x2 double, y2 double, conf double")
    got = [json.loads(r.value) for r in annotations.predictions_json(rows).collect()]
    assert got[0] == {"image_id": 42, "file_name": "d/0042.jpg", "category_id": 3, "bbox": [1.0, 2.0, 10.0, 20.0], "score": 0.12346} and "image_id" not in got[1]
    shapes = spark.createDataFrame([(5, 0, 1, 0.0, 0.0, 2.0, 3.0)], "image_id long, gt_id int, cls int, x1 double, y1 double, x2 double, y2 double")
    assert json.loads(annotations.shapes_json(shapes, "image_id", {1: "bus"}).first().value) == {"shapes": [{"label": "bus", "points": [[0.0, 0.0], [2.0, 0.0], [2.0, 3.0], [0.0, 3.0]], "shape_type": "rectangle"}], "imagePath": "5"}
    assert annotations.annotation_ids(shapes).first().annotation_id == (5 << 32) + 1


def test_headers_and_folders(spark, tmp_path):
    exif = b"Exif\0\0II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0"
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0\0\x11\x08" + struct.pack(">HH", 30, 40) + b"\0" * 12
    samples = {"a/x.png": images.encode_depth(np.ones((20, 12))), "b/y.jpg": jpeg, "b/z.webp": b"GIF89a" + struct.pack("<HH", 5, 50), "b/w.bmp": b"BM" + b"\0" * 16 + struct.pack("<ii", 16, -24), "c/bad.png": b"nothing", "c/note.txt": b"x"}
    for name, data in samples.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = images.scan(spark, str(tmp_path))
    got = {r.path.split("/")[-1]: (r.format, r.w, r.h, r.ok) for r in images.sizes(files).collect()}
    assert got == {"x.png": ("png", 12, 20, True), "y.jpg": ("jpeg", 30, 40, True), "z.webp": ("gif", 5, 50, False), "w.bmp": ("bmp", 16, 24, True), "bad.png": (None, None, None, False)}
    assert {r.name: r.cls for r in images.class_folders(files).collect()} == {"a": 0, "b": 1, "c": 2}
    assert images.first_by_path(files, 0.4).count() == 2 and images.first_by_path(files, 3).count() == 3


def test_depth_and_run_lengths():
    r = np.random.default_rng(0)
    metres = np.round(r.random((7, 9)) * 30, 3)
    assert np.allclose(images.decode_depth(images.encode_depth(metres)), metres)
    raw = (metres * 1000).round().astype(">u2")
    for kind in range(5):
        rows, above = [], np.zeros(18, int)
        for line in raw:
            cur = np.frombuffer(line.tobytes(), np.uint8).astype(int)
            left, diag = np.concatenate([[0, 0], cur[:-2]]), np.concatenate([[0, 0], above[:-2]])
            p = left + above - diag
            paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - diag)), left, np.where(abs(p - above) <= abs(p - diag), above, diag))
            rows.append(bytes([kind]) + ((cur - [0, left, above, (left + above) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes())
            above = cur
        chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 7, 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
        assert np.allclose(images.decode_depth(png), metres), kind
    mask = r.random((6, 5)) > 0.5
    assert np.array_equal(images.from_run_lengths(images.run_lengths(mask), 6, 5), mask)
    assert images.run_lengths(np.ones((2, 2))) == [0, 4] and images.run_lengths(np.zeros((2, 2))) == [4]


def test_outlines_and_key_points_of_documents(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.jpg", "width": 200, "height": 100}], "categories": [{"id": 13, "name": "stop"}],
           "annotations": [{"id": 1, "image_id": 1, "category_id": 13, "bbox": [20, 10, 40, 20], "iscrowd": 0, "segmentation": [[20, 10, 60, 10, 40, 30]], "keypoints": [30, 15, 2, 0, 0, 0]},
                           {"id": 2, "image_id": 1, "category_id": 1, "bbox": [0, 0, 10, 10]}, {"id": 3, "image_id": 1, "category_id": 1, "bbox": [0, 0, 10, 10], "segmentation": []},
                           {"id": 4, "image_id": 1, "category_id": 2, "bbox": [0, 0, 30, 10], "segmentation": [[0, 0, 4, 0, 4, 4], [20, 0, 30, 0, 30, 10]]},
                           {"id": 5, "image_id": 1, "category_id": 12, "bbox": [5, 5, 5, 5], "segmentation": []}, {"id": 6, "image_id": 1, "category_id": 3, "bbox": [5, 5, 0, 5]}, {"id": 7, "image_id": 1, "category_id": 3, "bbox": [5, 5, 5, 5], "iscrowd": 1}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    rows = annotations.coco_objects(annotations.read_coco(spark, str(tmp_path / "c.json")), from_91=True).collect()
    by = {r.cls: r for r in rows}
    assert len(rows) == 4 and set(by) == {11, 0, 1, None}
    assert by[11].segment == pytest.approx([0.1, 0.1, 0.3, 0.1, 0.2, 0.3]) and by[11].keypoints == pytest.approx([0.15, 0.15, 2, 0, 0, 0]) and (by[11].cx, by[11].h) == (0.2, 0.2)
    assert by[0].segment == pytest.approx([0, 0, 0.05, 0, 0.05, 0.1, 0, 0.1]) and by[0].keypoints is None
    ring = np.array(by[1].segment).reshape(-1, 2) * [200, 100]
    assert {tuple(p) for p in ring.round(6).tolist()} == {(0, 0), (4, 0), (4, 4), (20, 0), (30, 0), (30, 10)} and len(ring) >= 6


def test_pose_label_files(spark):
    files = [("ok", "0 0.5 0.5 0.2 0.2 0.1 0.2 2 0.3 0.4 0"), ("wide", "0 0.5 0.5 0.2 0.2 0.1 0.2 2"), ("far", "0 0.5 0.5 0.2 0.2 1.2 0.2 2 0.3 0.4 0"), ("word", "0 0.5 0.5 0.2 0.2 x 0.2 2 0.3 0.4 0"), ("none", "")]
    parsed = labels.parse(spark.createDataFrame(files, "path string, value string"), 1, keypoints=(2, 3))
    assert {r.path: r.status for r in parsed.collect()} == {"ok": "found", "wide": "corrupt", "far": "corrupt", "word": "corrupt", "none": "empty"}
    assert [[tuple(p) for p in r.kpts] for r in labels.poses(parsed, 3).collect()] == [[(0.1, 0.2, 2.0), (0.3, 0.4, 0.0)]]
    two = labels.parse(spark.createDataFrame([("a", "0 0.5 0.5 0.2 0.2 0.1 0.2 0 0")], "path string, value string"), 1, keypoints=(2, 2))
    assert [[p.v for p in r.kpts] for r in labels.poses(two, 2).collect()] == [[1.0, 0.0]]


def test_packed_run_lengths():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 5, 40):
        runs = r.integers(0, 5000, n).tolist()
        assert images.unpacked_runs(images.packed_runs(runs)) == runs
    assert images.packed_runs([6, 1, 40, 4, 5, 4, 5, 4, 21]) == "61X13mN000`0"
