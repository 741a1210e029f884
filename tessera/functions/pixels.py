"""Pixel kernels in numpy over rows (.., w, h, channels, pixels): sizes, colours, degradations, marks. No image library is needed for raw pixels.

Images are (h, w, channels) arrays of 8 bits. Each kernel takes an image and gives one; :func:`mapped`
runs them over a table, an Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def mapped(frames: DataFrame, kernel: Callable[[np.ndarray, dict], np.ndarray]) -> DataFrame:
    """``kernel(image, row)`` over pixel rows, whose other columns stay; a row without pixels stays as it is."""
    names = frames.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = pdf.to_dict("records")
            for r in rows:
                if r["pixels"] is not None:
                    out = kernel(np.frombuffer(r["pixels"], np.uint8).reshape(r["h"], r["w"], r["channels"]), r)
                    r["h"], r["w"], r["channels"], r["pixels"] = *out.shape, np.ascontiguousarray(out, np.uint8).tobytes()
            yield pd.DataFrame(rows, columns=names)

    return frames.mapInPandas(run, frames.schema)


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def resize(image: np.ndarray, w: int, h: int) -> np.ndarray:
    """Bilinear between pixel centres; the border repeats."""
    def places(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = places(image.shape[0], h), places(image.shape[1], w)
    x = image.astype(np.float64)
    rows = x[y0] * (1 - fy)[:, None, None] + x[y1] * fy[:, None, None]
    return _bytes(rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None])


def shrink(image: np.ndarray, most: int) -> np.ndarray:
    """No side longer than ``most``: each pixel is the mean of what it covers."""
    scale = most / max(image.shape[:2])
    if scale >= 1:
        return image
    x = image.astype(np.float64)
    for axis in (0, 1):
        n, m = x.shape[axis], max(1, int(x.shape[axis] * scale))
        edges = np.linspace(0, n, m + 1)
        total = np.concatenate([np.zeros_like(np.take(x, [0], axis)), np.cumsum(x, axis)], axis)
        low = np.floor(edges).astype(int)
        part = np.take(x, np.minimum(low, n - 1), axis) * np.expand_dims(edges - low, tuple(i for i in range(3) if i != axis))
        x = np.diff(np.take(total, low, axis) + part, axis=axis) * (m / n)
    return _bytes(x)


def letterbox(image: np.ndarray, size: int, up: bool = False, fill: int = 114) -> np.ndarray:
    """The image centred on a square canvas, made smaller (or with ``up`` larger) to fit; halves round to even."""
    h, w, c = image.shape
    r = size / max(h, w)
    r = r if up else min(1.0, r)
    nw, nh = round(w * r), round(h * r)
    inner = image if (nw, nh) == (w, h) else resize(image, nw, nh)
    out = np.full((size, size, c), fill, np.uint8)
    left, top = round((size - nw) / 2 - 0.1), round((size - nh) / 2 - 0.1)
    out[top : top + nh, left : left + nw] = inner
    return out


def centre_crop(image: np.ndarray, size: int) -> np.ndarray:
    """The middle square, resized."""
    h, w, _ = image.shape
    m = min(h, w)
    top, left = (h - m) // 2, (w - m) // 2
    return resize(image[top : top + m, left : left + m], size, size)


def normalised(image: np.ndarray, mean: tuple = (0.0, 0.0, 0.0), std: tuple = (1.0, 1.0, 1.0)) -> np.ndarray:
    """Channels first, 0 to 1, less the mean, by the deviation: a classifier's input."""
    return ((image.astype(np.float32) / 255 - np.array(mean, np.float32)) / np.array(std, np.float32)).transpose(2, 0, 1)


def hsv_gains(image: np.ndarray, hue: float, saturation: float, value: float) -> np.ndarray:
    """Hue turned by a share of half a turn, saturation and value multiplied by one plus a share."""
    x = image.astype(np.float64) / 255
    top, low = x.max(-1), x.min(-1)
    span = top - low
    safe = np.where(span > 0, span, 1)
    r, g, b = np.moveaxis(x, -1, 0)
    h = np.where(top == r, (g - b) / safe % 6, np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4)) * (span > 0)
    s = np.where(top > 0, span / np.where(top > 0, top, 1), 0)
    h, s, v = (h + 3 * hue) % 6, np.clip(s * (1 + saturation), 0, 1), np.clip(top * (1 + value), 0, 1)
    channel = lambda n: v - v * s * np.clip(np.minimum((n + h) % 6, 4 - (n + h) % 6), 0, 1)
    return _bytes(np.stack([channel(5), channel(3), channel(1)], -1) * 255)


def motion_blur(image: np.ndarray, length: int, angle: float) -> np.ndarray:
    """The mean along a line of ``length`` pixels at ``angle`` degrees; the border repeats."""
    steps = np.arange(length) - (length - 1) / 2
    dx, dy = np.rint(steps * np.cos(np.radians(angle))).astype(int), np.rint(steps * np.sin(np.radians(angle))).astype(int)
    h, w, _ = image.shape
    total = np.zeros(image.shape, np.float64)
    for x, y in zip(dx, dy, strict=True):
        total += image[np.clip(np.arange(h) + y, 0, h - 1)][:, np.clip(np.arange(w) + x, 0, w - 1)]
    return _bytes(total / length)


def haze(image: np.ndarray, density: float, light: int = 220) -> np.ndarray:
    """Mixed with the air's light, more towards the top (the far end)."""
    share = density * np.linspace(1, 0.4, image.shape[0])[:, None, None]
    return _bytes(image * (1 - share) + light * share)


def grain(image: np.ndarray, deviation: float, seed: int) -> np.ndarray:
    """Normal noise that the seed determines."""
    return _bytes(image + np.random.default_rng(seed).normal(0, deviation, image.shape))


def occluded(image: np.ndarray, rects: list[tuple[int, int, int, int]], fill: int = 0) -> np.ndarray:
    """Rectangles covered with one grey; ``spatial.cover_union`` drops the labels that they hide."""
    out = image.copy()
    for x1, y1, x2, y2 in rects:
        out[max(0, y1) : y2, max(0, x1) : x2] = fill
    return out


def outlined(image: np.ndarray, boxes: list[tuple[int, int, int, int]], colour: tuple = (255, 0, 0), width: int = 2) -> np.ndarray:
    """Boxes drawn as frames inside their edges."""
    out = image.copy()
    for x1, y1, x2, y2 in boxes:
        x1, y1 = max(0, x1), max(0, y1)
        inside = out[y1 + width : max(y1 + width, y2 - width), x1 + width : max(x1 + width, x2 - width)].copy()
        out[y1:y2, x1:x2] = np.array(colour[: image.shape[2]], np.uint8)
        out[y1 + width : y1 + width + inside.shape[0], x1 + width : x1 + width + inside.shape[1]] = inside
    return out


def blurred(image: np.ndarray, boxes: list[tuple[int, int, int, int]], ratio: float = 0.5) -> np.ndarray:
    """Boxes made unrecognisable: a box filter of ``ratio`` times 100 pixels."""
    out, k = image.copy(), max(1, int(ratio * 100))
    for x1, y1, x2, y2 in boxes:
        part = out[max(0, y1) : y2, max(0, x1) : x2]
        if part.size:
            for axis in (0, 1):
                n = part.shape[axis]
                low, high = np.clip(np.arange(n) - k // 2, 0, n), np.clip(np.arange(n) + (k + 1) // 2, 0, n)
                total = np.concatenate([np.zeros_like(np.take(part, [0], axis), dtype=np.float64), np.cumsum(part, axis, dtype=np.float64)], axis)
                shape = tuple(-1 if i == axis else 1 for i in range(3))
                part = (np.take(total, high, axis) - np.take(total, low, axis)) / (high - low).reshape(shape)
            out[max(0, y1) : y2, max(0, x1) : x2] = _bytes(part)
    return out


def box_prompts(boxes: np.ndarray, classes: np.ndarray, w: int, h: int, stride: int = 8) -> np.ndarray:
    """One mask a class, at ``stride`` pixels a cell: 1 where a box of it lies (a visual prompt)."""
    kinds = np.unique(classes)
    out = np.zeros((len(kinds), -(-h // stride), -(-w // stride)), np.uint8)
    for box, k in zip(boxes, np.searchsorted(kinds, classes), strict=True):
        x1, y1, x2, y2 = (int(v) for v in box / stride)
        out[k, y1:y2, x1:x2] = 1
    return out
