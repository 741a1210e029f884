"""Connected components by alternating large-star and small-star steps, without collecting anything.

Each step is a minimum by node and a join, so a hub's neighbours are never gathered in one row (a
hub's rows of the join are split by adaptive execution). The edges are written after every round, and
the round before is deleted; a round that leaves their count and checksum as they were has stars only,
and a star's centre is the least node of its component. Edges that are at most ``FINISH_EDGES`` are
finished by one task with a forest of their nodes; beyond that the rounds go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, stored_bytes

FILE_BYTES = 4 << 20
#: 16 MB of node numbers.
FINISH_EDGES = 1_000_000


class Forest:
    """Sets of 0 .. n - 1, each named by its least member."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        """Whether the two were apart."""
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b

    def flat(self) -> np.ndarray:
        """The root of every member."""
        while True:
            above = self.up[self.up]
            if (above == self.up).all():
                return self.up
            self.up[:] = above


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches]
    pairs = np.concatenate(held) if held else np.zeros((0, 2), np.int64)
    nodes, at = np.unique(pairs, return_inverse=True)
    forest = Forest(len(nodes))
    for a, b in at.reshape(-1, 2).tolist():
        forest.join(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[forest.flat()], pa.int64())], ["node", "component"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(u, v)`` longs → ``(node, component)`` for every node of an edge between two different nodes."""
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs, before = materialize(pairs, "edges"), None
    files = stored_bytes(pairs) // FILE_BYTES + 1  # edges do not grow: no more files than they fill
    for _ in range(most_rounds):
        state = pairs.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if state[0] <= FINISH_EDGES:
            return pairs.select("u", "v").coalesce(1).mapInArrow(_finish, "node long, component long")
        if before is not None and tuple(state) == before:
            break
        before = tuple(state)
        both = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct().coalesce(files), "edges")
        release(pairs)
        pairs = after
    else:
        raise RuntimeError(f"no convergence in {most_rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
