"""Counters over streaming track points."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.shapes import inside


def windowed_counts(points: DataFrame, every: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """(window, cls, n) by event time ``ts``; rows later than the watermark are dropped by Spark."""
    return points.withWatermark("ts", late).groupBy(F.window("ts", every), "cls").agg(F.count(F.lit(1)).alias("n"))


def region_windows(points: DataFrame, regions: dict[str, list[tuple[float, float]]], every: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """(window, region, n): points in each region by event time."""
    held = F.array_compact(F.array(*[F.when(inside(F.col("x"), F.col("y"), p), F.lit(name)) for name, p in regions.items()]))
    rows = points.withWatermark("ts", late).select("ts", F.explode(held).alias("region"))
    return rows.groupBy(F.window("ts", every), "region").agg(F.count(F.lit(1)).alias("n"))


def _meets(a: tuple, b: tuple, c: tuple, d: tuple) -> bool:
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    s1, s2, s3, s4 = side(c, d, a), side(c, d, b), side(a, b, c), side(a, b, d)
    on = lambda p, q, r: min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])
    return (s1 * s2 < 0 and s3 * s4 < 0) or (s1 == 0 and on(c, d, a)) or (s2 == 0 and on(c, d, b)) or (s3 == 0 and on(a, b, c)) or (s4 == 0 and on(a, b, d))


def line_counter(points: DataFrame, line: list[tuple[float, float]], forget: str | None = None) -> DataFrame:
    """(track_id, frame, direction) once a track, when it first crosses the line.

    State is a track's last point; ``forget`` drops it after so long without one (a query that
    should end by itself must not set it: pending timeouts keep it running).
    """
    (ax, ay), (bx, by) = line
    upright = abs(ax - bx) < abs(ay - by)
    limit = pd.Timedelta(forget) // pd.Timedelta("1ms") if forget else None

    def run(key: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out, empty = [], pd.DataFrame({"track_id": pd.Series(dtype="int64"), "frame": pd.Series(dtype="int32"), "direction": pd.Series(dtype=object)})
        if state.hasTimedOut:
            state.remove()
            yield empty
            return
        x, y, counted = state.get if state.exists else (None, None, False)
        for r in pd.concat(list(frames)).sort_values("frame").itertuples():
            if x is not None and not counted and _meets((x, y), (r.x, r.y), (ax, ay), (bx, by)):
                counted = True
                out.append((key[0], r.frame, "in" if (r.x > x if upright else r.y > y) else "out"))
            x, y = float(r.x), float(r.y)
        state.update((x, y, counted))
        if limit:
            state.setTimeoutDuration(limit)
        yield pd.DataFrame(out, columns=["track_id", "frame", "direction"]) if out else empty

    return points.groupBy("track_id").applyInPandasWithState(run, "track_id long, frame int, direction string", "x double, y double, counted boolean", "append", "ProcessingTimeTimeout" if limit else "NoTimeout")


def _within(p: tuple, polygon: list) -> bool:
    """Strictly inside."""
    odd = False
    for a, b in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        if _on(a, b, p):
            return False
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            odd = not odd
    return odd


def _on(a: tuple, b: tuple, p: tuple) -> bool:
    return (b[0] - a[0]) * (p[1] - a[1]) == (b[1] - a[1]) * (p[0] - a[0]) and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def _through(p: tuple, q: tuple, polygon: list) -> bool:
    """Whether the step from p to q runs inside the polygon and outside of it."""
    cuts, dx, dy = [0.0, 1.0], q[0] - p[0], q[1] - p[1]
    for a, b in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        ex, ey = b[0] - a[0], b[1] - a[1]
        if turn := dx * ey - dy * ex:
            t, u = ((a[0] - p[0]) * ey - (a[1] - p[1]) * ex) / turn, ((a[0] - p[0]) * dy - (a[1] - p[1]) * dx) / turn
            cuts += [t] if 0 <= t <= 1 and 0 <= u <= 1 else []
    cuts.sort()
    middles = [(p[0] + (s + t) / 2 * dx, p[1] + (s + t) / 2 * dy) for s, t in zip(cuts, cuts[1:], strict=False) if t > s]
    edge = lambda m: any(_on(a, b, m) for a, b in zip(polygon, [*polygon[1:], polygon[0]], strict=True))
    return any(_within(m, polygon) for m in middles) and any(not _within(m, polygon) and not edge(m) for m in middles)


def _per_track(points: DataFrame, out: str, state: str, step, start: tuple, forget: str | None) -> DataFrame:
    """``step(state, track, row) -> (state, output rows)`` over each track's points in order of frame."""
    limit, names = pd.Timedelta(forget) // pd.Timedelta("1ms") if forget else None, [c.split()[0] for c in out.split(", ")]

    def run(key: tuple, frames: Iterable[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now, rows = held.get if held.exists else start, []
        for r in pd.concat(list(frames)).sort_values("frame").itertuples():
            now, made = step(now, key[0], r)
            rows += made
        held.update(now)
        if limit:
            held.setTimeoutDuration(limit)
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return points.groupBy("track_id").applyInPandasWithState(run, out, state, "append", "ProcessingTimeTimeout" if limit else "NoTimeout")


def polygon_counter(points: DataFrame, polygon: list[tuple[float, float]], look_back: int = 5, forget: str | None = None) -> DataFrame:
    """(track_id, frame, direction) once a track, when it first enters or crosses the polygon: the stream form of ``tracks.region_entries``. State is a track's last points."""

    def step(now: tuple, track: int, r) -> tuple[tuple, list]:
        xs, ys, counted = list(now[0]), list(now[1]), now[2]
        here, before = (float(r.x), float(r.y)), (xs[-1], ys[-1]) if xs else None
        xs, ys = [*xs, here[0]][-look_back:], [*ys, here[1]][-look_back:]
        if before is None or counted or not (_within(here, polygon) or (not _within(before, polygon) and _through(before, here, polygon))):
            return (xs, ys, counted), []
        trail = list(zip(xs, ys, strict=True))
        base = next((p for p in trail if not _within(p, polygon)), trail[0])
        dx, dy = here[0] - base[0], here[1] - base[1]
        return (xs, ys, True), [(track, r.frame, "in" if (dx > 0 if abs(dx) > abs(dy) else dy > 0) else "out")]

    return _per_track(points, "track_id long, frame int, direction string", "xs array<double>, ys array<double>, counted boolean", step, ([], [], False), forget)


def speed_stream(points: DataFrame, history_size: int = 5, metres_per_pixel: float = 0.05, fps: float = 30.0, most: int = 120, forget: str | None = None) -> DataFrame:
    """(track_id, speed) once a track, at its ``history_size``-th point: the stream form of ``tracks.speeds``."""

    def step(now: tuple, track: int, r) -> tuple[tuple, list]:
        n, x, y, frame = now
        if n == 0:
            return (1, float(r.x), float(r.y), int(r.frame)), []
        seconds = (r.frame - frame) / fps
        done = n + 1 == history_size and seconds > 0
        far = ((r.x - x) ** 2 + (r.y - y) ** 2) ** 0.5 * metres_per_pixel
        return (n + 1, x, y, frame), [(track, min(most, int(far / seconds * 3.6)))] if done else []

    return _per_track(points, "track_id long, speed int", "n int, x double, y double, frame int", step, (0, 0.0, 0.0, 0), forget)


def repetition_stream(points: DataFrame, angle: str, up: float, down: float, forget: str | None = None) -> DataFrame:
    """(track_id, frame, reps) whenever a track's count goes up: the stream form of ``tracks.stage_repetitions``."""

    def step(now: tuple, track: int, r) -> tuple[tuple, list]:
        stage, reps = now
        value = getattr(r, angle)
        new = "up" if value > up else "down" if value < down else stage
        grown = stage == "down" and new == "up"
        return (new, reps + grown), [(track, r.frame, reps + 1)] if grown else []

    return _per_track(points, "track_id long, frame int, reps int", "stage string, reps int", step, ("", 0), forget)
