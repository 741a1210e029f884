"""Suffix-array dedup: maximal repeats from the common-prefix interval tree.

Bytes that a 100-byte string covers which also starts earlier are removed. Where repeats begin and
end (see :mod:`repeats` for how the corpus is cut down to those places, and dealt out), a suffix
array with longest common prefixes is built over the segments of one task's anchors. A scan with a
stack visits its common-prefix intervals; an interval whose suffixes are preceded by different bytes
is left-maximal, so it is a maximal repeat, reported as one group with all its occurrences. All
occurrences of a group but the earliest are removed. Inside a repeat, where whole segments agree, it
is their hashes that tell; both kinds of match are joined along their diagonals into whole repeats,
which :func:`groups` returns with all their occurrences.

Defined results: null text is an empty text; a text of under 100 bytes loses nothing, a very long one
is searched whole; matches never cross documents; of equal strings the one of the least (doc_id, hash
of the text, start) stays, so rows that repeat a doc_id with the same text lose the same bytes, with
different texts they count as ordered by a 64-bit hash of the text; a row without doc_id is kept whole
and makes nothing else a repeat; extra columns, whatever their names, are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, rows_of
from .repeats import Rolling, Spec, repeat_groups, repeated_spans, with_spans

WINDOW = 100
SEED_BYTES = 24
_VALUES = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64)


def byte_tokens(text: str) -> np.ndarray:
    return _VALUES[np.frombuffer(text.encode(), np.uint8)]


def enhanced_suffix_array(strings: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in the strings joined by a byte each, common prefix with the suffix before, byte before) in suffix order.

    Of all suffixes only those are kept that can begin a maximal repeat of ``least`` bytes: others
    share their first ``least`` bytes (told by a rolling hash), and not all of these are preceded by
    the same byte. The start of a string counts as a byte of its own. Prefixes end with the string.
    """
    lengths = np.array([len(s) for s in strings])
    bases = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    data = b"\0".join(strings) + b"\0"
    text = np.frombuffer(data, np.uint8)
    room = np.maximum(lengths - least + 1, 0)
    at = np.repeat(bases - (np.cumsum(room) - room), room) + np.arange(room.sum())
    ends = np.repeat(bases + lengths, room)
    if not len(at):
        return at, at, at
    before = np.where(np.isin(at, bases), -1 - at, text[at - 1].astype(np.int64))
    head = Rolling(_VALUES[text]).of(at, at + least)
    order = np.argsort(head, kind="stable")
    at, ends, before, head = at[order], ends[order], before[order], head[order]
    start = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    size = np.diff(np.concatenate([start, [len(head)]]))
    keep = np.repeat((size > 1) & (np.minimum.reduceat(before, start) != np.maximum.reduceat(before, start)), size)
    at, ends, before = at[keep], ends[keep], before[keep]
    if not len(at):
        return at, at, at
    suffixes = [data[a:b] for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
    order = np.array(sorted(range(len(suffixes)), key=suffixes.__getitem__))
    at, left, before = at[order], (ends - at)[order], before[order]
    common = np.zeros(len(at), np.int64)
    for i in range(1, len(at), 8192):  # adjacent suffixes side by side
        a, b = at[i - 1 : i + 8191], at[i : i + 8192]
        a, shorter = a[: len(b)], np.minimum(left[i - 1 : i - 1 + len(b)], left[i : i + 8192])
        reach = np.arange(int(shorter.max()))
        differ = (text[np.minimum(a[:, None] + reach, len(text) - 1)] != text[np.minimum(b[:, None] + reach, len(text) - 1)]) | (reach >= shorter[:, None])
        common[i : i + 8192] = np.where(differ.any(axis=1), differ.argmax(axis=1), shorter)
    return at, common, before


def maximal_repeats(strings: list[bytes], least: int = WINDOW) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places in the joined strings) of every maximal repeat of ``least`` bytes or more, with all its occurrences."""
    order, common, before = enhanced_suffix_array(strings, least)
    long = common >= least
    runs = np.flatnonzero(long & ~np.concatenate([[False], long[:-1]])) if len(order) else []
    mixed = None  # the mark of different bytes before
    for run in map(int, runs):
        stack: list[list] = []  # [prefix length, first row, byte before or mixed]
        row, left = run, int(before[run - 1])
        while True:
            height = int(common[row]) if row < len(common) else 0
            start, carried = row - 1, left
            while stack and stack[-1][0] > height:
                size, start, sides = stack.pop()
                carried = sides if sides == carried else mixed
                if carried is mixed:
                    yield size, order[start:row]
            if height < least:
                break
            if stack and stack[-1][0] == height:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == carried else mixed
            else:
                stack.append([height, start, carried])
            left = int(before[row])
            row += 1


def scan(groups: list[list[tuple]]) -> Iterator[tuple]:
    """Segments of some anchors → (g, lo, *MATCH) of the occurrences that are not their group's first; shorter ones inside longer ones go."""
    rows = [r for group in groups if len(group) > 1 for r in group]
    if not rows:
        return
    keys = sorted(range(len(rows)), key=lambda i: rows[i][1:4])
    rows = [rows[i] for i in keys]
    strings = [r[5] for r in rows]
    bases = np.concatenate([[0], np.cumsum([len(s) + 1 for s in strings])])
    low = np.array([r[3] for r in rows])
    id_of: dict = {}
    docs = np.array([id_of.setdefault(r[1:3], len(id_of)) for r in rows])  # ascending with (doc, twin)
    found = []
    for size, places in maximal_repeats(strings):
        which = np.searchsorted(bases, places, side="right") - 1
        start = low[which] + places - bases[which]
        doc = docs[which]
        first = np.lexsort((start, doc))[0]
        again = (doc != doc[first]) | (start != start[first])
        n = int(again.sum())
        found.append(np.stack([which[again], start[again], start[again] + size, np.full(n, which[first]), np.full(n, start[first])]))
    if not found:
        return
    which, start, stop, source, at = np.concatenate(found, axis=1)
    order = np.lexsort((-stop, start, which))
    which, start, stop, source, at = which[order], start[order], stop[order], source[order], at[order]
    shift = which * (int(stop.max()) + 2)
    reach = np.maximum.accumulate(stop + shift)
    new = np.concatenate([[True], (stop + shift)[1:] > reach[:-1]])  # not inside what starts before it
    for i, a, b, j, z in zip(*[x[new].tolist() for x in (which, start, stop, source, at)], strict=True):
        yield rows[i][0], rows[i][3], rows[i][1], rows[i][2], a, b, rows[j][1], rows[j][2], z


SPEC = Spec(window=WINDOW, k=SEED_BYTES, tokens=byte_tokens, units=str.encode, cut=lambda u, a, b: u[a:b], within=True, most_segments=8192, anew=True, kernel=scan)


def groups(docs: DataFrame) -> DataFrame:
    """Repeats of 100 bytes or more with all their occurrences (see :func:`repeats.repeat_groups`)."""
    return repeat_groups(docs, SPEC)


def kept_bytes(data: bytes, starts: list | None, stops: list | None) -> bytes:
    out, at = [], 0
    for a, b in zip(starts or (), stops or (), strict=True):
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for doc_ids, texts, starts, stops in rows_of(batches, "doc", "text", "starts", "stops"):
        data = [t.encode() for t in texts]
        kept = [kept_bytes(d, a, b) for d, a, b in zip(data, starts, stops, strict=True)]
        cells = [pa.array(doc_ids, pa.int64()), pa.array(map(len, data), pa.int64()), pa.array([len(d) - len(k) for d, k in zip(data, kept, strict=True)], pa.int64()), pa.array([len(a or ()) for a in starts], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        yield pa.RecordBatch.from_arrays(cells, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return with_spans(docs, repeated_spans(docs, SPEC)).mapInArrow(_report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


OP5_SQL = r"""
with d as (select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as x, octet_length(encode(coalesce(text, ''))) as n from documents),
m as (select rid, doc_id, p, md5(substr(x, 2 * p + 1, 200)) as h from (select rid, doc_id, x, unnest(range(0, n - 99)) as p from d where n >= 100)),
r as (select rid, p from (select rid, p, row_number() over (partition by h order by doc_id, p) as k from m) where k > 1),
spans as (select rid, min(p) as a, max(p) + 100 as b from (select rid, p, sum(fresh) over (partition by rid order by p) as k from (
  select rid, p, case when p - lag(p) over (partition by rid order by p) <= 100 then 0 else 1 end as fresh from r)) group by rid, k),
gaps as (select rid, b as a, coalesce(lead(a) over (partition by rid order by a), 1000000000000) as b from (select rid, a, b from spans union all select distinct rid, -1, 0 from spans)),
kept as (select g.rid, string_agg(substr(x, 2 * g.a + 1, 2 * (least(g.b, n) - g.a)), '' order by g.a) as t from gaps g join d using (rid) group by g.rid),
counts as (select rid, sum(b - a) as removed, count(*) as spans from spans group by rid)
select doc_id, cast(n as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, cast(coalesce(spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(t, x))) as kept_sha256
from d left join counts using (rid) left join kept using (rid)
"""
