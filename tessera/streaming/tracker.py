"""Multi-object tracking: detections of a stream's frames in, tracks out, state between frames.

Each frame is matched in three steps: tracks and lost tracks with confident detections (overlap
times score), what is left of the tracked ones with weak detections (overlap alone), tentative
tracks with the confident detections left. New tracks start from what nobody claims; they are
confirmed at their second hit, or on a stream's first frame. A lost track is forgotten after
``buffer`` frames. :class:`Rules` has what other trackers add to that:

* ``BOT``: a filter of width and height, and the camera's motion (``warp``, an affine map a frame);
* ``OC``: a cost for turning away from the direction of a track's own observations, a second look with
  tracks at their last observed place, and states rebuilt along a straight line after a gap; no step
  with weak detections;
* ``FAST``: a track that another one covers is taken back to its state some frames ago, slowed down and
  kept for longer; no new track where one is.

On a stream the state lives in Spark's state store, one value a stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import kalman
from .assign import match


@dataclass(frozen=True)
class Rules:
    high: float = 0.25
    low: float = 0.1
    new: float = 0.25
    buffer: int = 30
    first: float = 0.8
    second: float = 0.5
    tentative: float = 0.7
    fuse_score: bool = True
    duplicate: float = 0.15
    form: str = "xyah"
    weak: bool = True  # the step with weak detections
    inertia: float = 0.0  # weight of the cost for another direction
    back: int = 3  # frames that a direction looks back
    recover: bool = False  # a second look at last observed places
    rebuild: bool = False  # states after a gap
    covered: float = 1.0  # a track covered by more than this is hidden
    hidden: int = 10  # frames that it may stay so
    reappear: int = 40  # frames that it is kept beyond the buffer
    undo_place: int = 3
    undo_speed: int = 5
    enlarge: float = 1.1
    slow: float = 0.5
    new_overlap: float = 1.0  # no new track on one that overlaps it by as much


BYTE = Rules()
BOT = Rules(form="xywh")
OC = Rules(inertia=0.2, recover=True, rebuild=True, weak=False)
FAST = Rules(covered=0.7, new_overlap=0.7)


@dataclass
class Track:
    id: int
    state: str  # tentative, tracked, lost
    score: float
    cls: int
    start: int
    frame: int
    mean: list
    cov: list
    seen: list = field(default_factory=list)  # last observations: [frame, x1, y1, x2, y2]
    saved: list | None = None  # mean and covariance at the last one
    missed: int = 0
    hidden: int = 0
    hidden_at: int = -1
    past: list = field(default_factory=list)  # means of the last hits


@dataclass
class Memory:
    next_id: int = 1
    frame: int = 0
    tracks: list[Track] = field(default_factory=list)

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def load(text: str | None) -> Memory:
        if not text:
            return Memory()
        d = json.loads(text)
        return Memory(d["next_id"], d["frame"], [Track(**t) for t in d["tracks"]])


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of every box of ``a`` with every box of ``b``."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.prod(np.clip(high - low, 0, None), -1)
    size = lambda x: np.prod(x[:, 2:] - x[:, :2], -1)
    return inter / (size(a)[:, None] + size(b)[None] - inter + 1e-7)


#: Up to so many pairs plain floats are faster than arrays.
FEW = 100


def overlaps(a: list, b: list) -> list[list[float]]:
    """:func:`overlap` of lists of boxes, as nested lists."""
    if len(a) * len(b) > FEW:
        return overlap(np.array(a, float), np.array(b, float)).tolist()
    out, sizes = [], [(q[2] - q[0]) * (q[3] - q[1]) for q in b]
    for x1, y1, x2, y2 in a:
        size, row = (x2 - x1) * (y2 - y1), []
        for (u1, v1, u2, v2), other in zip(b, sizes, strict=True):
            w, h = (x2 if x2 < u2 else u2) - (x1 if x1 > u1 else u1), (y2 if y2 < v2 else v2) - (y1 if y1 > v1 else v1)
            inter = w * h if w > 0 and h > 0 else 0.0
            row.append(inter / (size + other - inter + 1e-7) if inter else 0.0)
        out.append(row)
    return out


def _boxes(tracks: list[Track], rules: Rules) -> list:
    return [kalman.box_of(t.mean, rules.form) for t in tracks]


def _predicted(tracks: list[Track], rules: Rules) -> None:
    """Moves tracks on by a frame; lost ones keep their height, and of form ``xywh`` their width."""
    many = []
    for t in tracks:
        if t.state == "lost":
            t.mean = [*t.mean[:6], 0.0 if rules.form == "xywh" else t.mean[6], 0.0]
        if kalman.alone(t.cov):
            t.mean, t.cov = kalman.predict_one(t.mean, t.cov, rules.form)
        else:
            many.append(t)
    if many:
        mean, cov = kalman.predict(np.array([t.mean for t in many]), np.array([t.cov for t in many]), rules.form)
        for t, m, c in zip(many, mean.tolist(), cov.tolist(), strict=True):
            t.mean, t.cov = m, c


def _rebuilt(track: Track, box: np.ndarray, frame: int, rules: Rules) -> None:
    """Takes the state back to the last observation and along a straight line to ``box``."""
    last, gap = np.array(track.seen[-1][1:]), frame - int(track.seen[-1][0])
    way = last + (box - last) * (np.arange(1, gap) / gap)[:, None]
    mean, cov = kalman.follow(*map(np.array, track.saved), kalman.to_measure(way, rules.form), rules.form)
    mean, cov = kalman.predict(mean[None], cov[None], rules.form)
    track.mean, track.cov = mean[0].tolist(), cov[0].tolist()


def _hit(tracks: list[Track], boxes: np.ndarray, scores: np.ndarray, classes: np.ndarray, frame: int, rules: Rules) -> None:
    if not tracks:
        return
    if rules.rebuild:
        for t, b in zip(tracks, boxes, strict=True):
            if t.state == "lost" and t.saved and frame - t.seen[-1][0] > 1:
                _rebuilt(t, b, frame, rules)
    mean, cov = kalman.update(np.array([t.mean for t in tracks]), np.array([t.cov for t in tracks]), kalman.to_measure(boxes, rules.form), rules.form)
    for t, m, c, s, k, b in zip(tracks, mean, cov, scores, classes, boxes, strict=True):
        t.mean, t.cov, t.score, t.cls, t.state, t.frame, t.missed, t.hidden = m.tolist(), c.tolist(), float(s), int(k), "tracked", frame, 0, 0
        _remember(t, b, frame, rules)


def _remember(t: Track, box: np.ndarray, frame: int, rules: Rules) -> None:
    if rules.inertia or rules.recover or rules.rebuild:
        t.seen = [*t.seen, [frame, *map(float, box)]][-(rules.back + 2) :]
        t.saved = [t.mean, t.cov]
    if rules.covered < 1:
        t.past = [*t.past, t.mean][-(max(rules.undo_place, rules.undo_speed) + 4) :]


def _centre(box: np.ndarray) -> np.ndarray:
    return (box[..., :2] + box[..., 2:4]) / 2


def turns(tracks: list[Track], boxes: np.ndarray, back: int) -> np.ndarray:
    """Angle, in half turns, between each track's direction over its last ``back`` frames and the way to each box; 0 where either has none."""
    cost = np.zeros((len(tracks), len(boxes)))
    for i, t in enumerate(tracks):
        if len(t.seen) < 2 or not len(boxes):
            continue
        now = t.seen[-1]
        before = next((o for o in reversed(t.seen) if o[0] <= now[0] - back), t.seen[0])
        at = _centre(np.array(now[1:]))
        own, way = at - _centre(np.array(before[1:])), _centre(boxes) - at
        far = np.linalg.norm(way, axis=1)
        if np.linalg.norm(own) > 1e-6:
            cos = (way @ own) / np.maximum(far, 1e-6) / np.linalg.norm(own)
            cost[i] = np.where(far > 1e-6, np.arccos(np.clip(cos, -1, 1)) / np.pi, 0)
        else:
            cost[i] = np.where(far > 1e-6, 0.5, 0)
    return cost


def _hide(tracks: list[Track], others: list[Track], frame: int, rules: Rules) -> None:
    """Unmatched tracks: those that another one covers are hidden for a while, the rest are lost after two frames."""
    theirs = _boxes(others, rules)
    for t, (x1, y1, x2, y2) in zip(tracks, _boxes(tracks, rules), strict=True):
        inter = (max(0.0, min(x2, u2) - max(x1, u1)) * max(0.0, min(y2, v2) - max(y1, v1)) for u1, v1, u2, v2 in theirs)
        cover = max(inter, default=0.0) / max((x2 - x1) * (y2 - y1), 1e-7)
        t.missed += 1
        if t.hidden:
            t.hidden += 1
        elif cover > rules.covered:
            t.hidden, t.hidden_at = 1, frame
            mean = list(t.mean)
            if len(t.past) >= rules.undo_speed:
                mean[4:] = t.past[-rules.undo_speed][4:]
            if len(t.past) >= rules.undo_place:
                mean[:4] = t.past[-rules.undo_place][:4]
            mean[3] *= rules.enlarge
            mean[4:] = [v * rules.slow for v in mean[4:]]
            t.mean = mean
        if t.hidden > rules.hidden or (not t.hidden and t.missed > 2):
            t.state, t.hidden = "lost", 0


def advance(memory: Memory, boxes: np.ndarray, scores: np.ndarray, classes: np.ndarray, frame: int, rules: Rules = BYTE, warp: np.ndarray | None = None) -> list[tuple[Track, int]]:
    """Moves ``memory`` on by a frame; returns the confirmed tracks seen on it with their detections."""
    if frame > memory.frame + 1:  # frames without detections have no rows
        memory.tracks = [t for t in memory.tracks if t.state != "tentative" and _kept(t, frame - 1, rules)]
        for t in memory.tracks:
            t.state = "lost"
    for _ in range(max(1, frame - memory.frame) if memory.tracks else 0):
        # tentative tracks stand still, so most are dropped before their covariance is asked for
        _predicted([t for t in memory.tracks if warp is not None or t.state != "tentative"], rules)
    if warp is not None and memory.tracks:
        mean, cov = kalman.warp(np.array([t.mean for t in memory.tracks]), np.array([t.cov for t in memory.tracks]), warp)
        for t, m, c in zip(memory.tracks, mean, cov, strict=True):
            t.mean, t.cov = m.tolist(), c.tolist()
    first_frame, memory.frame = memory.frame == 0, frame
    box, score = boxes.tolist(), scores.tolist()
    valid = [d for d, (x1, y1, x2, y2) in enumerate(box) if x2 > x1 and y2 > y1]
    strong, weak = [d for d in valid if score[d] >= rules.high], [d for d in valid if rules.low < score[d] < rules.high]
    seen: list[tuple[Track, int]] = []

    def step(tracks: list[Track], dets: list[int], limit: float, fuse: bool, direction: bool = False, at_last: bool = False) -> tuple[list[Track], list[int]]:
        if not tracks or not dets:
            return tracks, dets
        places = [t.seen[-1][1:] if t.seen else kalman.box_of(t.mean, rules.form) for t in tracks] if at_last else _boxes(tracks, rules)
        weights = [score[d] if fuse else 1.0 for d in dets]
        cost = [[1 - iou * w for iou, w in zip(row, weights, strict=True)] for row in overlaps(places, [box[d] for d in dets])]
        if min(map(min, cost)) > limit:  # another direction costs more still
            return tracks, dets
        cost = np.array(cost)
        if direction and rules.inertia:
            cost = cost + rules.inertia * turns(tracks, boxes[dets], rules.back)
        pairs = match(cost, limit) if (cost <= limit).any() else []
        if not pairs:
            return tracks, dets
        chosen, at = [tracks[i] for i, _ in pairs], [dets[j] for _, j in pairs]
        if warp is None:
            _predicted([t for t in chosen if t.state == "tentative"], rules)
        _hit(chosen, boxes[at], scores[at], classes[at], frame, rules)
        seen.extend(zip(chosen, at, strict=True))
        taken_t, taken_d = {i for i, _ in pairs}, {j for _, j in pairs}
        return [t for i, t in enumerate(tracks) if i not in taken_t], [d for j, d in enumerate(dets) if j not in taken_d]

    tentative = [t for t in memory.tracks if t.state == "tentative"]
    pool = [t for t in memory.tracks if t.state != "tentative"]
    was_tracked = {t.id for t in pool if t.state == "tracked"}
    left, strong = step(pool, strong, rules.first, rules.fuse_score, direction=True)
    if rules.recover:  # those still tracked come before lost ones
        here, strong = step([t for t in left if t.id in was_tracked], strong, rules.first, rules.fuse_score, at_last=True)
        there, strong = step([t for t in left if t.id not in was_tracked], strong, rules.first, rules.fuse_score, at_last=True)
        left = here + there
    unseen = [t for t in left if t.id in was_tracked]
    if rules.weak:
        unseen, _ = step(unseen, weak, rules.second, False)
    if rules.covered < 1:
        _hide(unseen, [t for t, _ in seen], frame, rules)
    else:
        for t in unseen:
            t.state = "lost"
    gone, strong = step(tentative, strong, rules.tentative, rules.fuse_score)
    dropped = {t.id for t in gone}
    if first_frame and rules.new_overlap < 1:  # they are tracked at once, so that each may stand in the next one's way
        for d in strong:
            active = [t for t in memory.tracks if t.state == "tracked" and t.id not in dropped]
            if not active or max(overlaps([box[d]], _boxes(active, rules))[0]) < rules.new_overlap:
                seen.extend(_started(memory, box, score, classes, [d], frame, rules, "tracked"))
    else:
        if rules.new_overlap < 1 and strong and (active := [t for t in memory.tracks if t.state == "tracked" and t.id not in dropped]):
            strong = [d for d, row in zip(strong, overlaps([box[d] for d in strong], _boxes(active, rules)), strict=True) if max(row) < rules.new_overlap]
        seen.extend(_started(memory, box, score, classes, strong, frame, rules, "tracked" if first_frame else "tentative"))
    memory.tracks = [t for t in memory.tracks if t.id not in dropped and _kept(t, frame, rules)]
    drop = duplicates(memory.tracks, rules)
    memory.tracks = [t for t in memory.tracks if t.id not in drop]
    alive = {t.id for t in memory.tracks}
    return [(t, d) for t, d in seen if t.state == "tracked" and t.id in alive]


def _started(memory: Memory, boxes: list, scores: list, classes: np.ndarray, dets: list[int], frame: int, rules: Rules, state: str) -> list[tuple[Track, int]]:
    """New tracks from the detections that score enough, with these."""
    out = []
    for d in dets:
        if not scores[d] >= rules.new:
            continue
        t = Track(memory.next_id, state, scores[d], int(classes[d]), frame, frame, *kalman.start_one(kalman.measure_of(boxes[d], rules.form), rules.form))
        _remember(t, boxes[d], frame, rules)
        memory.next_id += 1
        memory.tracks.append(t)
        out.append((t, d))
    return out


def _kept(t: Track, frame: int, rules: Rules) -> bool:
    """Whether a lost track is not forgotten yet."""
    return t.state != "lost" or frame - t.frame <= rules.buffer or (t.hidden_at >= 0 and frame - t.hidden_at <= rules.reappear)


def duplicates(tracks: list[Track], rules: Rules) -> set[int]:
    """Of a tracked and a lost track on the same spot, the one that has lived shorter (the tracked one on a tie)."""
    a, b = [t for t in tracks if t.state == "tracked"], [t for t in tracks if t.state == "lost"]
    if not a or not b:
        return set()
    rows = overlaps(_boxes(a, rules), _boxes(b, rules))
    near = ((x, y) for x, row in zip(a, rows, strict=True) for y, iou in zip(b, row, strict=True) if 1 - iou < rules.duplicate)
    return {x.id if x.frame - x.start <= y.frame - y.start else y.id for x, y in near}


OUT = "stream_id long, frame int, track_id long, det_id int, cls int, score double, x1 double, y1 double, x2 double, y2 double"
STATE = "memory string"
INPUT = ("stream_id", "frame", "det_id", "cls", "conf", "x1", "y1", "x2", "y2")
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


#: By how much a pair may miss a limit and still not be left out beforehand; the frame itself decides.
SLACK = 1e-6


class Frames:
    """A stream's sorted detections as arrays, and where a track that is one frame old may be hit."""

    def __init__(self, pdf: pd.DataFrame, rules: Rules) -> None:
        frame = pdf["frame"].to_numpy()
        starts = np.flatnonzero(np.append(True, frame[1:] != frame[:-1]))
        self.rules, self.frame, self.starts = rules, frame[starts].astype(int), np.append(starts, len(frame))
        self.at = np.repeat(np.arange(len(starts)), np.diff(self.starts))  # frame of each detection, counted from 0
        self.boxes, self.scores = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float), pdf["conf"].to_numpy(float)
        self.classes, self.det = pdf["cls"].to_numpy(), pdf["det_id"].to_numpy()
        self.strong = (self.boxes[:, 2] > self.boxes[:, 0]) & (self.boxes[:, 3] > self.boxes[:, 1]) & (self.scores >= rules.high)
        new = self.strong & (self.scores >= rules.new)
        self.new = np.append(0, np.cumsum(np.bincount(self.at[new], minlength=len(starts))))  # tracks that start before each frame if none is hit
        follows = np.append(False, np.diff(self.frame) == 1)
        b, a = np.flatnonzero(self.strong & follows[self.at]), np.flatnonzero(new)
        n = np.diff(self.new)[self.at[b] - 1]
        i = np.repeat(b, n)
        j = a[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.new[self.at[b] - 1], n)]
        near = np.zeros(len(starts) + 1, bool)
        near[self.at[i[self.close(kalman.to_box(kalman.to_measure(self.boxes[j], rules.form), rules.form), i, rules.tentative)]]] = near[-1] = True
        self.near = np.flatnonzero(near)

    def close(self, places: np.ndarray, dets: np.ndarray, limit: float) -> np.ndarray:
        """Whether each place may be matched with its detection."""
        b = self.boxes[dets]
        side = np.clip(np.minimum(places[:, 2:], b[:, 2:]) - np.maximum(places[:, :2], b[:, :2]), 0, None)
        inter, size = side[:, 0] * side[:, 1], lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
        iou = inter / (size(places) + size(b) - inter + 1e-7)
        return ~(1 - (iou * self.scores[dets] if self.rules.fuse_score else iou) > limit + SLACK)

    def quiet(self, memory: Memory, k: int) -> int:
        """The first frame from ``k`` on at which something may be hit, where all tracks are lost or tentative."""
        end = int(self.near[np.searchsorted(self.near, k)])
        lost = [t for t in memory.tracks if t.state == "lost"]
        if end == k or not lost:
            return end
        last = np.array([max(t.frame + self.rules.buffer, t.hidden_at + self.rules.reappear if t.hidden_at >= 0 else 0) for t in lost])
        stop = min(end, int(np.searchsorted(self.frame, last.max() + 1, "right")))  # then all are forgotten
        d = self.starts[k] + np.flatnonzero(self.strong[self.starts[k] : self.starts[stop]])
        if not len(d):
            return end
        means = np.array([t.mean for t in lost])
        means[:, 6 if self.rules.form == "xywh" else 7 :] = 0
        ahead = self.frame[self.at[d]] - memory.frame
        places = means[:, None, :4] + ahead[None, :, None] * means[:, None, 4:]
        all_d, there = np.tile(d, len(lost)), np.repeat(last, len(d)) >= np.tile(self.frame[self.at[d]], len(lost)) - 1
        hit = self.close(kalman.to_box(places, self.rules.form).reshape(-1, 4), all_d, self.rules.first)
        if self.rules.recover:
            seen = np.array([t.seen[-1][1:] if t.seen else [0.0] * 4 for t in lost], float)
            hit |= self.close(np.repeat(seen, len(d), 0), all_d, self.rules.first)
        found = self.at[all_d[hit & there]]
        return min(end, int(found.min())) if len(found) else end

    def skip(self, memory: Memory, k: int, end: int) -> None:
        """Moves ``memory`` over frames at which nothing is hit: lost tracks go on or are forgotten, tentative ones live for a frame."""
        frame, rules = int(self.frame[end - 1]), self.rules
        lost = [t for t in memory.tracks if t.state == "lost" and _kept(t, frame, rules)]
        if lost:
            mean, cov = np.array([t.mean for t in lost]), np.array([t.cov for t in lost])
            mean[:, 6 if rules.form == "xywh" else 7 :] = 0
            mean, cov = kalman.predict_many(mean, cov, frame - memory.frame, rules.form)
            for t, m, c in zip(lost, mean.tolist(), cov.tolist(), strict=True):
                t.mean, t.cov = m, c
        memory.tracks, memory.frame = lost, frame
        memory.next_id += int(self.new[end - 1] - self.new[k])
        rows = slice(self.starts[end - 1], self.starts[end])
        _started(memory, self.boxes[rows].tolist(), self.scores[rows].tolist(), self.classes[rows], np.flatnonzero(self.strong[rows]).tolist(), frame, rules, "tentative")


def run_frames(memory: Memory, stream_id: int, pdf: pd.DataFrame, rules: Rules) -> pd.DataFrame:
    """Frames of ``pdf`` in ascending order; a frame at or before the last one seen is ignored.

    Frames at which no track can be hit are passed over at once; :func:`advance` runs for the others.
    """
    out: list[tuple] = []
    pdf = pdf[pdf["frame"] > memory.frame].sort_values(["frame", "det_id"])
    if not len(pdf):
        return pd.DataFrame(out, columns=COLUMNS)
    frames, warps = Frames(pdf, rules), pdf["warp"].to_numpy() if "warp" in pdf else None
    k, n = 0, len(frames.frame)
    while k < n:
        if k and warps is None and all(t.state != "tracked" for t in memory.tracks):
            end = frames.quiet(memory, k)
            if end > k:
                frames.skip(memory, k, end)
                k = end
                continue
        start, frame = frames.starts[k], int(frames.frame[k])
        rows = slice(start, frames.starts[k + 1])
        camera = np.array(warps[start], float).reshape(2, 3) if warps is not None and warps[start] is not None else None
        for t, d in advance(memory, frames.boxes[rows], frames.scores[rows], frames.classes[rows], frame, rules, camera):
            out.append((stream_id, frame, t.id, int(frames.det[start + d]), t.cls, t.score, *kalman.to_box(np.array(t.mean), rules.form).tolist()))
        k += 1
    return pd.DataFrame(out, columns=COLUMNS)


def track_stream(detections: DataFrame, rules: Rules = BYTE, forget: str | None = None) -> DataFrame:
    """Tracks of a streaming DataFrame of detections (stream_id, frame from 1, det_id, cls, conf, x1..y2[, warp]).

    ``forget`` drops the state of a stream that has been silent for so long (a query that should end by
    itself must not set it: pending timeouts keep it running).
    """
    limit = pd.Timedelta(forget) // pd.Timedelta("1ms") if forget else None

    def run(key: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=COLUMNS)
            return
        memory = Memory.load(state.get[0] if state.exists else None)
        pdf = pd.concat(list(frames))
        out = run_frames(memory, key[0], pdf, rules)
        state.update((memory.dump(),))
        if limit:
            state.setTimeoutDuration(limit)
        yield out

    return detections.groupBy("stream_id").applyInPandasWithState(run, OUT, STATE, "append", "ProcessingTimeTimeout" if limit else "NoTimeout")


def track_table(detections: DataFrame, rules: Rules = BYTE, parts: int = 61, counted: bool = False) -> DataFrame:
    """The same over a finished table. With ``counted``, ``frame`` is any number that rises, and its values are counted from 1 in each stream.

    A stream is one task, as its frames depend on one another. They come sorted, an Arrow batch at a
    time, and the tracker's memory is carried over: a task holds a batch, not its stream.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, memory, rest = object(), Memory(), pd.DataFrame()

        def moved(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            nonlocal stream, memory
            for key, rows in pdf.groupby("stream_id", sort=False, dropna=False):
                key = None if pd.isna(key) else int(key)
                if key != stream:
                    stream, memory = key, Memory()
                if counted:  # whole frames come, and none is left out: the last one is as many as there were
                    rows = rows.assign(frame=(rows["frame"].diff() != 0).cumsum() + memory.frame)
                yield run_frames(memory, key, rows, rules)

        for pdf in batches:
            if len(pdf):
                pdf = pd.concat([rest, pdf], ignore_index=True) if len(rest) else pdf
                ends = pdf[["stream_id", "frame"]].fillna(-1)
                last = (ends == ends.iloc[-1]).all(axis=1)  # the batch's last frame may go on in the next one
                rest = pdf[last]
                yield from moved(pdf[~last])
        if len(rest):
            yield from moved(rest)

    ordered = detections.select(*INPUT, *(["warp"] if "warp" in detections.columns else [])).where("frame is not null").repartition(parts, "stream_id").sortWithinPartitions("stream_id", "frame", "det_id")
    return ordered.mapInPandas(run, OUT)
