"""One-to-one assignment of least cost, with a price for staying alone."""

from __future__ import annotations

import numpy as np


def hungarian(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a square matrix, total cost least; shortest augmenting paths with potentials."""
    n = len(cost)
    u, v, row_of = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, n)
    for i in range(n):
        row_of[n], col = i, n
        best, way, done = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while row_of[col] != n:
            done[col] = True
            slack = cost[row_of[col]] - u[row_of[col]] - v[:n]
            better = ~done[:n] & (slack < best)
            best[better], way[better] = slack[better], col
            open_ = np.flatnonzero(~done[:n])
            nxt = open_[np.argmin(best[open_])]
            delta = best[nxt]
            used = np.flatnonzero(done)
            u[row_of[used]] += delta
            v[used] -= delta
            best[open_] -= delta
            col = nxt
        while col != n:
            row_of[col] = row_of[way[col]]
            col = way[col]
    out = np.empty(n, int)
    out[row_of[:n]] = np.arange(n)
    return out


def match(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Pairs of an optimal partial assignment in which no pair costs more than ``limit``."""
    rows, cols = np.flatnonzero((cost <= limit).any(1)), np.flatnonzero((cost <= limit).any(0))
    if len(rows) < cost.shape[0] or len(cols) < cost.shape[1]:  # the others stay alone in any case
        return [(int(rows[i]), int(cols[j])) for i, j in match(cost[np.ix_(rows, cols)], limit)]
    n, m = cost.shape
    if not n or not m:
        return []
    if n == m == 1:
        return [(0, 0)]
    square = np.full((n + m, n + m), limit / 2)
    square[:n, :m] = np.where(cost > limit, 1e6, cost)
    square[n:, m:] = 0
    to = hungarian(square)[:n]
    return [(i, int(j)) for i, j in enumerate(to) if j < m and cost[i, j] <= limit]
