"""Constant-velocity Kalman filters over boxes, for arrays of tracks at once.

A filter's ``form`` says what it measures: ``xyah`` (centre, aspect, height; all deviations go by the
height, aspect's are fixed) or ``xywh`` (centre, width, height; deviations go by the side they belong to).
"""

from __future__ import annotations

import numpy as np

#: Deviations of position and velocity as shares of a side.
POSITION, VELOCITY = 1 / 20, 1 / 160
STEP = np.eye(8) + np.eye(8, k=4)
PAIRED = (STEP + STEP.T) > 0  # a place and its speed


def to_measure(xyxy: np.ndarray, form: str = "xyah") -> np.ndarray:
    w, h = xyxy[..., 2] - xyxy[..., 0], xyxy[..., 3] - xyxy[..., 1]
    out = np.empty((*w.shape, 4))  # filled by columns: np.stack takes longer than all arithmetic on few boxes
    out[..., 0], out[..., 1], out[..., 2], out[..., 3] = xyxy[..., 0] + w / 2, xyxy[..., 1] + h / 2, w / h if form == "xyah" else w, h
    return out


def to_box(mean: np.ndarray, form: str = "xyah") -> np.ndarray:
    cx, cy, a, h = mean[..., 0], mean[..., 1], mean[..., 2], mean[..., 3]
    w = a * h if form == "xyah" else a
    out = np.empty((*w.shape, 4))
    out[..., 0], out[..., 1], out[..., 2], out[..., 3] = cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2
    return out


def deviations(sides: np.ndarray, position: float, aspect: float, velocity: float, turn: float, form: str = "xyah") -> np.ndarray:
    """Of tracks whose measures' last two numbers are ``sides``."""
    out = np.empty((*sides.shape[:-1], 8))
    if form == "xyah":
        h = sides[..., 1:2]
        out[..., :4], out[..., 4:], out[..., 2], out[..., 6] = position * h, velocity * h, aspect, turn
    else:
        out[..., :2] = out[..., 2:4] = position * sides
        out[..., 4:6] = out[..., 6:] = velocity * sides
    return out


def _squares(sd: np.ndarray) -> np.ndarray:
    """Diagonal matrices of the squares."""
    n = sd.shape[1]
    out = np.zeros((len(sd), n, n))
    out[:, range(n), range(n)] = sd**2
    return out


def start(measure: np.ndarray, form: str = "xyah") -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of new tracks (n, 4)."""
    sd = deviations(measure[:, 2:4], 2 * POSITION, 1e-2, 10 * VELOCITY, 1e-5, form)
    return np.concatenate([measure, np.zeros_like(measure)], 1), _squares(sd)


def predict(mean: np.ndarray, cov: np.ndarray, form: str = "xyah") -> tuple[np.ndarray, np.ndarray]:
    sd = deviations(mean[:, 2:4], POSITION, 1e-2, VELOCITY, 1e-5, form)
    return mean @ STEP.T, STEP @ cov @ STEP.T + _squares(sd)


def alone(cov: list) -> bool:
    """Whether no measure has to do with another, given nested lists: all but a camera's motion leaves it so."""
    return all(8 - row.count(0.0) == (row[i] != 0) + (row[(i + 4) % 8] != 0) for i, row in enumerate(cov))


def _paired(a: list, b: list, d: list) -> list:
    """Covariance, as nested lists, of places ``a``, speeds ``d`` and each with its own ``b``."""
    out = [[0.0] * 8 for _ in range(8)]
    for i in range(4):
        out[i][i], out[i][i + 4], out[i + 4][i], out[i + 4][i + 4] = a[i], b[i], b[i], d[i]
    return out


def _spread(sides: list, place: float, aspect: float, form: str) -> list:
    """Variances of four numbers whose deviations are ``place`` times a side, those of an aspect ``aspect``."""
    w, h = place * sides[0], place * sides[1]
    return [h * h, h * h, aspect * aspect, h * h] if form == "xyah" else [w * w, h * h, w * w, h * h]


def start_one(measure: list, form: str = "xyah") -> tuple[list, list]:
    """:func:`start` of one track, in plain floats: on few tracks they take a tenth of small arrays' time."""
    sides = measure[2:]
    return [*measure, 0.0, 0.0, 0.0, 0.0], _paired(_spread(sides, 2 * POSITION, 1e-2, form), [0.0] * 4, _spread(sides, 10 * VELOCITY, 1e-5, form))


def predict_one(mean: list, cov: list, form: str = "xyah") -> tuple[list, list]:
    """:func:`predict` of one track whose covariance is :func:`alone`, in plain floats."""
    moved, turned = _spread(mean[2:4], POSITION, 1e-2, form), _spread(mean[2:4], VELOCITY, 1e-5, form)
    a, b, d = [], [], []
    for i in range(4):
        own, with_speed, speed = cov[i][i], cov[i][i + 4], cov[i + 4][i + 4]
        b.append(with_speed + speed)
        a.append(own + with_speed + b[i] + moved[i])
        d.append(speed + turned[i])
    return [mean[0] + mean[4], mean[1] + mean[5], mean[2] + mean[6], mean[3] + mean[7], *mean[4:]], _paired(a, b, d)


def box_of(mean: list, form: str = "xyah") -> tuple[float, float, float, float]:
    """:func:`to_box` of one mean."""
    x, y, h = mean[0], mean[1], mean[3]
    w = mean[2] * h if form == "xyah" else mean[2]
    return x - w / 2, y - h / 2, x + w / 2, y + h / 2


def measure_of(box: list, form: str = "xyah") -> list:
    """:func:`to_measure` of one box."""
    w, h = box[2] - box[0], box[3] - box[1]
    return [box[0] + w / 2, box[1] + h / 2, w / h if form == "xyah" else w, h]


def predict_many(mean: np.ndarray, cov: np.ndarray, steps: int, form: str = "xyah") -> tuple[np.ndarray, np.ndarray]:
    """:func:`predict` so many times, of tracks whose sides that deviations go by do not change."""
    sd = deviations(mean[:, 2:4], POSITION, 1e-2, VELOCITY, 1e-5, form)
    noise = _squares(sd)
    for _ in range(steps):
        mean, cov = mean @ STEP.T, STEP @ cov @ STEP.T + noise
    return mean, cov


def _seen(mean: np.ndarray, cov: np.ndarray, form: str) -> np.ndarray:
    sd = deviations(mean[:, 2:4], POSITION, 1e-1, 0, 0, form)[:, :4]
    return cov[:, :4, :4] + _squares(sd)


def update(mean: np.ndarray, cov: np.ndarray, measure: np.ndarray, form: str = "xyah") -> tuple[np.ndarray, np.ndarray]:
    seen = _seen(mean, cov, form)
    gain = np.swapaxes(np.linalg.solve(seen, cov[:, :4, :]), 1, 2)
    return mean + (gain @ (measure - mean[:, :4])[..., None])[..., 0], cov - gain @ seen @ np.swapaxes(gain, 1, 2)


def follow(mean: np.ndarray, cov: np.ndarray, measures: np.ndarray, form: str = "xyah") -> tuple[np.ndarray, np.ndarray]:
    """:func:`predict` and :func:`update` by each measure in turn, for one track: (8,), (8, 8), (n, 4).

    Where no measure has to do with another (a camera's motion mixes them), each is a filter of two
    numbers, and plain floats are many times as fast as small matrices.
    """
    if np.any(cov[~PAIRED]):
        mean, cov = mean[None], cov[None]
        for z in measures:
            mean, cov = update(*predict(mean, cov, form), z[None], form)
        return mean[0], cov[0]
    at, speed = mean[:4].tolist(), mean[4:].tolist()
    a, b, d = np.diagonal(cov)[:4].tolist(), np.diagonal(cov, 4).tolist(), np.diagonal(cov)[4:].tolist()
    for z in measures.tolist():
        if form == "xyah":
            moved, turned = [POSITION * at[3]] * 4, [VELOCITY * at[3]] * 4
            moved[2], turned[2] = 1e-2, 1e-5
        else:
            moved, turned = [POSITION * at[i] for i in (2, 3, 2, 3)], [VELOCITY * at[i] for i in (2, 3, 2, 3)]
        for i in range(4):
            at[i] += speed[i]
            a[i], b[i], d[i] = a[i] + b[i] + (b[i] + d[i]) + moved[i] ** 2, b[i] + d[i], d[i] + turned[i] ** 2
        if form == "xyah":
            noise = [POSITION * at[3]] * 4
            noise[2] = 1e-1
        else:
            noise = [POSITION * at[i] for i in (2, 3, 2, 3)]
        for i in range(4):
            seen = a[i] + noise[i] ** 2
            g, h, off = a[i] / seen, b[i] / seen, z[i] - at[i]
            at[i], speed[i] = at[i] + g * off, speed[i] + h * off
            a[i], b[i], d[i] = a[i] - g * seen * g, b[i] - g * seen * h, d[i] - h * seen * h
    out, n = np.zeros((8, 8)), np.arange(4)
    out[n, n], out[n, n + 4], out[n + 4, n], out[n + 4, n + 4] = a, b, b, d
    return np.array(at + speed), out


def gate(mean: np.ndarray, cov: np.ndarray, measures: np.ndarray, form: str = "xyah") -> np.ndarray:
    """Squared Mahalanobis distance of every track to every measurement."""
    off = measures[None] - mean[:, None, :4]
    return np.einsum("nmi,nij,nmj->nm", off, np.linalg.inv(_seen(mean, cov, form)), off)


def warp(mean: np.ndarray, cov: np.ndarray, affine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States of form ``xywh`` under the camera's motion (2 x 3, last frame to this one): all pairs turn, the place shifts."""
    turn = np.kron(np.eye(4), affine[:, :2])
    mean = mean @ turn.T
    mean[:, :2] += affine[:, 2]
    return mean, turn @ cov @ turn.T
