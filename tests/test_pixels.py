from __future__ import annotations

import colorsys

import numpy as np
import pytest

from tessera.functions import pixels as px
from tessera.sources import datasets as ds

IMAGE = np.random.default_rng(0).integers(0, 256, (40, 60, 3), np.uint8)


def test_sizes():
    assert np.array_equal(px.resize(IMAGE, 60, 40), IMAGE) and px.resize(IMAGE, 7, 9).shape == (9, 7, 3)
    ramp = np.repeat(np.arange(0, 250, 10, dtype=np.uint8)[None, :, None], 4, 0)
    assert np.abs(px.resize(ramp, 50, 4)[0, 1:-1, 0].astype(float) - (np.arange(50) * 5 - 2.5)[1:-1]).max() <= 0.51
    small = px.shrink(IMAGE, 30)
    assert small.shape == (20, 30, 3) and np.abs(small - IMAGE.reshape(20, 2, 30, 2, 3).mean((1, 3))).max() <= 0.51
    assert px.shrink(IMAGE, 100) is IMAGE and abs(px.shrink(IMAGE, 37).mean() - IMAGE.mean()) < 1
    box = px.letterbox(IMAGE, 64)
    assert box.shape == (64, 64, 3) and np.array_equal(box[12:52, 2:62], IMAGE) and (box[:12] == 114).all()
    assert px.letterbox(IMAGE, 30)[5:25].std() > 10 and px.letterbox(IMAGE, 120, up=True)[20:100].std() > 10
    assert px.centre_crop(IMAGE, 40).shape == (40, 40, 3) and np.array_equal(px.centre_crop(IMAGE, 40), IMAGE[:, 10:50])
    assert px.normalised(IMAGE, (0.5, 0.5, 0.5), (0.5, 0.5, 0.5))[1, 3, 4] == pytest.approx(IMAGE[3, 4, 1] / 127.5 - 1, abs=1e-5)


def test_colours():
    assert np.abs(px.hsv_gains(IMAGE, 0, 0, 0).astype(int) - IMAGE).max() <= 1
    got = px.hsv_gains(IMAGE, 0.3, -0.4, 0.2)
    for y, x in ((0, 0), (5, 7), (30, 59)):
        h, s, v = colorsys.rgb_to_hsv(*(IMAGE[y, x] / 255))
        want = colorsys.hsv_to_rgb((h + 0.15) % 1, min(1, s * 0.6), min(1, v * 1.2))
        assert np.abs(got[y, x] / 255 - want).max() < 0.01


def test_degradations():
    assert np.array_equal(px.motion_blur(IMAGE, 1, 30), IMAGE)
    line = np.zeros((9, 21, 1), np.uint8)
    line[4, 10] = 250
    assert px.motion_blur(line, 5, 0)[4, 8:13, 0].tolist() == [50] * 5 and px.motion_blur(line, 5, 90)[2:7, 10, 0].tolist() == [50] * 5
    assert px.haze(IMAGE, 0.5).std() < IMAGE.std() and np.array_equal(px.haze(IMAGE, 0.0), IMAGE) and (px.haze(IMAGE, 1.0)[0] == 220).all()
    assert np.array_equal(px.grain(IMAGE, 5, 1), px.grain(IMAGE, 5, 1)) and not np.array_equal(px.grain(IMAGE, 5, 1), px.grain(IMAGE, 5, 2))
    hidden = px.occluded(IMAGE, [(-5, 3, 10, 9)], 7)
    assert (hidden[3:9, :10] == 7).all() and np.array_equal(hidden[9:], IMAGE[9:])


def test_marks():
    drawn = px.outlined(IMAGE, [(5, 6, 25, 30)])
    assert (drawn[6:8, 5:25] == (255, 0, 0)).all() and np.array_equal(drawn[8:28, 7:23], IMAGE[8:28, 7:23]) and np.array_equal(drawn[31:], IMAGE[31:])
    soft = px.blurred(IMAGE, [(5, 6, 25, 30)])
    assert soft[6:30, 5:25].std() < 0.3 * IMAGE.std() and np.array_equal(soft[:6], IMAGE[:6])
    masks = px.box_prompts(np.array([[0, 0, 16, 8], [16, 16, 32, 32]]), np.array([4, 2]), 40, 32)
    assert masks.shape == (2, 4, 5) and masks[1, 0].tolist() == [1, 1, 0, 0, 0] and masks[0, 2:, 2:4].all() and masks.sum() == 6


def test_over_tables(spark):
    rows = ds.from_arrays(spark, [IMAGE, IMAGE[:10]])
    got = px.mapped(rows, lambda image, row: px.shrink(image, 30)).orderBy("path").collect()
    assert [(r.w, r.h, len(r.pixels)) for r in got] == [(30, 20, 1800), (30, 5, 450)] and bytes(got[0].pixels) == px.shrink(IMAGE, 30).tobytes()
