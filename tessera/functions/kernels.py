"""Polygon and mask kernels in numpy, and their column forms as Arrow functions (for what columns cannot express)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"


def shoelace(p: np.ndarray) -> float:
    if len(p) < 3:
        return 0.0
    q = np.roll(p, -1, axis=0)
    return float(abs((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum()) / 2)


def clip_to_window(p: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """A convex polygon cut to a window, one half-plane after the other."""
    for axis, limit, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        if not len(p):
            break
        inside = sign * (p[:, axis] - limit) >= 0
        out = []
        for i, a in enumerate(p):
            b, k = p[(i + 1) % len(p)], (i + 1) % len(p)
            if inside[i]:
                out.append(a)
            if inside[i] != inside[k]:
                out.append(a + (b - a) * ((limit - a[axis]) / (b[axis] - a[axis])))
        p = np.array(out).reshape(-1, 2)
    return p


def foreground_share(p: np.ndarray, window: tuple[float, float, float, float]) -> float:
    """Intersection over the polygon's own area."""
    own = shoelace(p)
    return shoelace(clip_to_window(p, *window)) / own if own > 0 else 0.0


def resample(p: np.ndarray, n: int) -> np.ndarray:
    """``n`` points along the closed ring, evenly spaced by vertex index."""
    ring = np.concatenate([p, p[:1]])
    x = np.linspace(0, len(ring) - 1, n)
    return np.stack([np.interp(x, np.arange(len(ring)), ring[:, i]) for i in range(2)], 1)


def hull(p: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise."""
    pts = sorted(set(map(tuple, p.tolist())))
    if len(pts) < 3:
        return np.array(pts)

    def half(order):
        out: list = []
        for q in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(pts) + half(reversed(pts)))


def least_rectangle(p: np.ndarray) -> tuple[float, float, float, float, float]:
    """(cx, cy, w, h, theta) of the enclosing rectangle of least area, theta in [0, pi / 2); one of its sides lies on the hull."""
    h = hull(np.asarray(p, float))
    if len(h) == 1:
        return float(h[0][0]), float(h[0][1]), 0.0, 0.0, 0.0
    edges = np.roll(h, -1, axis=0) - h
    best = None
    for t in np.unique(np.round(np.arctan2(edges[:, 1], edges[:, 0]) % (np.pi / 2), 12)):
        turn = np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]])
        q = h @ turn.T
        low, high = q.min(0), q.max(0)
        size = high - low
        if best is None or size.prod() < best[0] - 1e-9:
            best = (size.prod(), *((low + high) / 2 @ turn), *size, t)
    return tuple(map(float, best[1:]))  # type: ignore[return-value]


def bridge(parts: list[np.ndarray]) -> np.ndarray:
    """Polygons joined into one ring: each to the next over their nearest points, out on the way there and back on the way home."""
    if len(parts) == 1:
        return parts[0]
    links = []
    for a, b in zip(parts, parts[1:], strict=False):
        d = ((a[:, None] - b[None]) ** 2).sum(-1)
        links.append(np.unravel_index(d.argmin(), d.shape))
    out: list[np.ndarray] = []

    def walk(k: int, enter: int) -> None:
        ring = np.roll(parts[k], -enter, axis=0)
        ring = np.concatenate([ring, ring[:1]])
        if k == len(links):
            out.append(ring)
            return
        leave = (links[k][0] - enter) % len(parts[k])
        out.append(ring[: leave + 1])
        walk(k + 1, links[k][1])
        out.append(ring[leave:])

    walk(0, 0)
    return np.concatenate(out)


def fill(p: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mask of the pixels whose centre is inside the polygon (even-odd)."""
    ys, mask = np.arange(h) + 0.5, np.zeros((h, w), bool)
    xs = np.arange(w) + 0.5
    for a, b in zip(p, np.roll(p, -1, axis=0), strict=True):
        rows = np.flatnonzero((a[1] > ys) != (b[1] > ys))
        if len(rows):
            cut = (b[0] - a[0]) * (ys[rows] - a[1]) / (b[1] - a[1]) + a[0]
            mask[rows] ^= xs[None] < cut[:, None]
    return mask


def overlap_mask(parts: list[np.ndarray], h: int, w: int) -> np.ndarray:
    """Instance numbers from 1, larger shapes first, so that smaller ones stay visible."""
    masks = [fill(p, h, w) for p in parts]
    out = np.zeros((h, w), np.int32)
    for k, i in enumerate(sorted(range(len(masks)), key=lambda i: -int(masks[i].sum()))):
        out[masks[i]] = k + 1
    return out


def regions(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Four-connected regions numbered from 1."""
    label, n = np.zeros(mask.shape, np.int32), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if label[start]:
            continue
        n += 1
        label[start], queue = n, deque([start])
        while queue:
            y, x = queue.popleft()
            for a, b in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not label[a, b]:
                    label[a, b] = n
                    queue.append((a, b))
    return label, n


def drop_small(mask: np.ndarray, least: int, holes: bool = False) -> np.ndarray:
    """The mask without regions (or holes) of under ``least`` pixels; the largest region stays in any case."""
    mask = np.asarray(mask, bool)
    label, n = regions(~mask if holes else mask)
    sizes = np.bincount(label.ravel(), minlength=n + 1)
    small = [i for i in range(1, n + 1) if sizes[i] < least]
    if holes:
        return mask | np.isin(label, small)
    keep = [i for i in range(1, n + 1) if i not in small] or ([int(np.argmax(sizes[1:])) + 1] if n else [])
    return np.isin(label, keep)


def outline(mask: np.ndarray) -> np.ndarray:
    """The largest region's outer border as a ring of pixel corners."""
    label, n = regions(np.asarray(mask, bool))
    if not n:
        return np.zeros((0, 2))
    m = np.pad(label == int(np.argmax(np.bincount(label.ravel(), minlength=n + 1)[1:])) + 1, 1)
    y, x = (int(v[0]) for v in np.nonzero(m))
    at, step, ring = (x, y), (1, 0), []
    while True:  # the region stays to the right of the walk
        ring.append(at)
        px, py = at
        left, right = {(1, 0): ((px, py - 1), (px, py)), (0, 1): ((px, py), (px - 1, py)), (-1, 0): ((px - 1, py), (px - 1, py - 1)), (0, -1): ((px - 1, py - 1), (px, py - 1))}[step]
        if m[left[1], left[0]]:
            step = (step[1], -step[0])
        elif not m[right[1], right[0]]:
            step = (-step[1], step[0])
        at = (at[0] + step[0], at[1] + step[1])
        if at == (x, y):
            break
    pts = np.array(ring, float) - 1
    before, after = np.roll(pts, 1, axis=0), np.roll(pts, -1, axis=0)
    turn = (pts - before)[:, 0] * (after - pts)[:, 1] - (pts - before)[:, 1] * (after - pts)[:, 0]
    return pts[turn != 0]


def _points(value) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in value], float).reshape(-1, 2) if value is not None else np.zeros((0, 2))


def iof_column(points: Column, window: Column) -> Column:
    """Share of a convex polygon inside a window (an array of four numbers)."""

    def run(p: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([foreground_share(_points(a), tuple(map(float, b))) for a, b in zip(p, w, strict=True)], dtype=float)

    return F.pandas_udf(run, "double")(points, window)


def rectangle_column(points: Column) -> Column:
    def run(p: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([least_rectangle(_points(a)) if a is not None and len(a) else (None,) * 5 for a in p], columns=["cx", "cy", "w", "h", "theta"]).astype(float)

    return F.pandas_udf(run, "cx double, cy double, w double, h double, theta double")(points)


def resample_column(points: Column, n: int) -> Column:
    def run(p: pd.Series) -> pd.Series:
        return pd.Series([[{"x": x, "y": y} for x, y in resample(_points(a), n).tolist()] if a is not None and len(a) else [] for a in p])

    return F.pandas_udf(run, POINTS)(points)


def whole_groups(batches: Iterator[pd.DataFrame], *keys: str) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``keys`` come in batches; yields frames that end where a group ends, so that no group is cut."""
    rest = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        last = np.ones(len(pdf), bool)
        for k in keys:
            last &= (pdf[k] == pdf[k].iloc[-1]).to_numpy() | (pdf[k].isna() & pd.isna(pdf[k].iloc[-1])).to_numpy()
        cut = len(pdf) - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield pdf.iloc[:cut]
        rest = pdf.iloc[cut:]
    if rest is not None and len(rest):
        yield rest


def group_slices(pdf: pd.DataFrame, *keys: str) -> Iterator[slice]:
    """Slices of consecutive rows that agree in ``keys``."""
    new = np.ones(len(pdf), bool)
    if len(pdf) > 1:
        new[1:] = False
        for k in keys:
            v = pdf[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(new).tolist()
    yield from map(slice, starts, [*starts[1:], len(pdf)])
