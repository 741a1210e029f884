"""What the two exact repeat removers share: which stretches of documents occur earlier, at any scale.

Tokens are bytes or words, a window is W of them. Every window's anchor is the least of its K-token
hashes (leftmost on a tie), so equal windows have equal anchors at equal places; the consecutive
windows of one anchor form a segment, a stretch of under 2 W tokens.

1. All anchors are found: place, window range, anchor hash, segment hash.
2. Anchors that occur once are dropped (counted by a 32-bit hash of theirs: a collision only keeps
   a few more). What is left is proportional to the repeated part of the corpus.
3. Segments of one anchor and of equal hash (64 bits over all tokens of the segment) are taken as
   equal; all but the first are matches of the first as a whole.
4. First segments that share an anchor but not their whole content (the ends of repeats) are
   compared: their contents go to the anchor's task and a kernel finds the matches. An anchor with
   more than ``most_segments`` different segments is split: its windows are cut anew by their two
   least hashes, then by their three least, and so on (equal windows agree in these, too), and steps
   3 and 4 run over the parts. After ``levels`` cuts a part is a single window.
5. Matches that go on along one diagonal (same earlier document, same distance) are joined, which
   makes them as long as they are in both; a document's spans are the union of its matches.

Groupings are minima that combine before the shuffle; joins are equi-joins that AQE may split, or
broadcasts of written tables whose size was checked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, release, rows_of

BATCH_TOKENS = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_OTHER = 0xD1342543DE82EF95 | 1
_OTHER_INVERSE = pow(_OTHER, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int, inverse: int) -> None:
        self.base, self.inverse = base, inverse
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 17)
            steps = lambda b: np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size - 1, b, np.uint64))])
            self.up, self.down = steps(np.uint64(self.base)), steps(np.uint64(self.inverse))
        return self.up[:n], self.down[:n]


_POWERS = {}


class Rolling:
    """Polynomial hashes of any stretch of a token array, two array reads each."""

    def __init__(self, tokens: np.ndarray, second: bool = False) -> None:
        base = (_OTHER, _OTHER_INVERSE) if second else (_BASE, _INVERSE)
        powers = _POWERS.setdefault(base, Powers(*base))
        up, self.down = powers.upto(len(tokens) + 1)
        self.sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * up[: len(tokens)], out=self.sums[1:])

    def every(self, size: int) -> np.ndarray:
        """Of all stretches of ``size`` tokens."""
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


PLACE_BITS = 16
_PLACES = np.uint64((1 << PLACE_BITS) - 1)


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the least value in each window of ``width``, leftmost on a tie.

    Values are compared by their upper 48 bits, whatever their number: stretches are worked on whose
    places fit the lower 16. So equal windows have equal minima in every document.
    """
    n = len(values) - width + 1
    step = (1 << PLACE_BITS) - width
    out = np.empty(max(n, 0), np.int64)
    for at in range(0, n, step):
        part = values[at : at + step + width - 1]
        low, size = part >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | np.arange(len(part), dtype=np.uint64), 1
        while size * 2 <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        m = len(part) - width + 1
        out[at : at + m] = (np.minimum(low[:m], low[width - size : width - size + m]) & _PLACES).astype(np.int64) + at
    return out


@dataclass(frozen=True)
class Spec:
    """``tokens``: text → 64-bit tokens. ``units``: text → what ``cut`` takes (start, stop) stretches from, as bytes for the kernel."""

    window: int
    k: int
    tokens: Callable[[str], np.ndarray]
    units: Callable[[str], object]
    cut: Callable[[object, int, int], bytes]
    within: bool  # whether an earlier start in the same document counts
    most_segments: int  # different segments of one anchor that a kernel takes
    anew: bool  # find anchors twice instead of writing them all once
    kernel: Callable[[list], Iterator[tuple]]  # groups of (g, doc, twin, lo, offset, content) → (g, lo, *MATCH)
    levels: int = 4  # how often an anchor of too many segments is cut anew; the last time into single windows


def anchors(tokens: np.ndarray, spec: Spec) -> tuple[np.ndarray, ...]:
    """(place, first window, last window, anchor hash, segment hash) of a document's segments."""
    if len(tokens) < spec.window:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    rolling = Rolling(tokens)
    grams = rolling.every(spec.k)
    at = leftmost_minima(grams, spec.window - spec.k + 1)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    place = at[first].astype(np.int64)
    return place, first, last, grams[place].view(np.int64), rolling.of(first, last + spec.window).view(np.int64)


def finer(rolling: Rolling, first: int, last: int, place: int, level: int, spec: Spec) -> list[tuple[int, int, int, int, int]]:
    """(place, first, last, hash, segment hash): the windows of a segment cut by their ``level + 1`` least hashes; singly at the last level."""
    width = spec.window - spec.k + 1
    values = mixed((rolling.sums[first + spec.k : last + width + spec.k] - rolling.sums[first : last + width]) * rolling.down[first : last + width])
    rows = np.lib.stride_tricks.sliding_window_view(values >> np.uint64(PLACE_BITS), width)
    least = np.sort(np.argsort(rows, axis=1, kind="stable")[:, : level + 1] + np.arange(len(rows))[:, None], axis=1)
    new = np.concatenate([[True], (least[1:] != least[:-1]).any(axis=1)]) if level < spec.levels else np.ones(len(rows), bool)
    starts = np.flatnonzero(new)
    ends = np.concatenate([starts[1:] - 1, [len(rows) - 1]])
    key = np.full(len(starts), np.uint64(level))
    for column in least[starts].T:
        key = mixed(key * np.uint64(_OTHER) + values[column] + (column - least[starts, 0]).astype(np.uint64) + (least[starts, 0] + first - place).astype(np.uint64))
    if level >= spec.levels:
        key = mixed(rolling.of(starts + first, starts + first + spec.window) + np.uint64(level))
    content = rolling.of(starts + first, ends + first + spec.window)
    return list(zip([place] * len(starts), (starts + first).tolist(), (ends + first).tolist(), key.view(np.int64).tolist(), content.view(np.int64).tolist(), strict=True))


def _batch(names: list[str], kinds: list, rows: list[tuple]) -> pa.RecordBatch:
    cells = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names)


#: A stretch of a document that also starts at ``at`` of the earlier (source, source_twin).
MATCH = "doc long, twin long, start int, stop int, source long, source_twin long, at int"
MATCH_NAMES, MATCH_KINDS = [x.split()[0] for x in MATCH.split(", ")], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
SEGMENT = "doc long, twin long, lo int, more short, offset short, g long, s long"


def twin_of(text: Column) -> Column:
    """A 64-bit hash of the text, for the case that rows share a doc_id."""
    return F.xxhash64(text)


def identified(docs: DataFrame) -> DataFrame:
    """doc, twin (a hash of the text: tells rows apart that share a doc_id), text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").alias("doc"), twin_of(text).alias("twin"), text.alias("text"))


def _segments(rows: DataFrame, spec: Spec) -> DataFrame:
    """The segments of all documents whose anchor occurs more than once."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, twins, texts in rows_of(batches, "doc", "twin", "text", step=128):
            found = [anchors(spec.tokens(t), spec) for t in texts]
            counts = [len(f[0]) for f in found]
            place, first, last, g, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*found, strict=True))
            cells = [pa.array(np.repeat(np.array(doc_ids, np.int64), counts)), pa.array(np.repeat(np.array(twins, np.int64), counts)), pa.array(first, pa.int32()), pa.array((last - first).astype(np.int16)), pa.array((place - first).astype(np.int16)), pa.array(g), pa.array(s)]
            yield pa.RecordBatch.from_arrays(cells, ["doc", "twin", "lo", "more", "offset", "g", "s"])

    every = rows.where("doc is not null").mapInArrow(find, SEGMENT)
    every = every if spec.anew else materialize(every, "anchors")
    short = F.expr("cast(pmod(g, 4294967296) - 2147483648 as int)")
    often = materialize(every.select(short.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "often")
    shared = materialize(every.withColumn("h", short).join(broadcast_if_small(often), "h", "left_semi").drop("h"), "shared")
    release(often)
    if not spec.anew:
        release(every)
    return shared


def matches(docs: DataFrame, spec: Spec) -> DataFrame:
    """MATCH rows: stretches that occur earlier, each as far as one anchor's task sees it; :func:`repeats` joins them."""
    rows, w, found = identified(docs), spec.window, []
    shared = _segments(rows, spec)
    here = F.struct("doc", "twin", "lo")
    later = F.expr("struct(doc, twin, lo) > f") if spec.within else F.expr("doc > f.doc")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["g", "lead", *MATCH_NAMES], [pa.int64(), pa.int32(), *MATCH_KINDS]
        group, held, size = [], [], 0
        for columns in rows_of(batches, "g", "doc", "twin", "lo", "offset", "content", step=4096):
            for row in zip(*columns, strict=True):
                if group and group[0][0] != row[0]:
                    held.append(group)
                    size += sum(len(r[5]) for r in group)
                    group = []
                    if size >= BATCH_TOKENS:
                        yield _batch(names, kinds, list(spec.kernel(held)))
                        held, size = [], 0
                group.append(row)
        if group:
            held.append(group)
        if held:
            yield _batch(names, kinds, list(spec.kernel(held)))

    for level in range(1, spec.levels + 2):
        firsts = materialize(shared.groupBy("g", "s").agg(F.min(here).alias("f")), "firsts")
        many = firsts.groupBy("g").agg(F.count(F.lit(1)).alias("segments")).where("segments > 1")
        marked = materialize(shared.join(firsts, ["g", "s"]).select("doc", "twin", "lo", "more", "offset", "g", "f", later.alias("later")), "marked")
        release(shared)
        found.append(marked.where("later").select("doc", "twin", F.col("lo").alias("start"), (F.col("lo") + F.col("more") + w).alias("stop"), F.col("f.doc").alias("source"), F.col("f.twin").alias("source_twin"), F.col("f.lo").alias("at")))
        if level > spec.levels:
            break  # single windows: a part has one content
        lead = F.expr("struct(doc, twin, lo) = f")
        leads = marked.where(lead).join(many, "g")
        hot = F.col("segments") > spec.most_segments
        asked = leads.groupBy("doc", "twin").agg(F.collect_list(F.struct("lo", "more", "offset", "g", hot.alias("hot"))).alias("wanted"))
        asked = materialize(asked.withColumnsRenamed({"doc": "d_", "twin": "t_"}), "asked")
        release(firsts)
        texts = rows.join(broadcast_if_small(asked), F.expr("doc = d_ and twin = t_"))

        def fetch(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.binary(), pa.int16(), pa.int64()]
            names = ["g", "doc", "twin", "lo", "offset", "content", "more", "s"]
            for doc_ids, twins, texts, wanted in rows_of(batches, "doc", "twin", "text", "wanted", step=64):
                out = []
                for d, twin, text, asked in zip(doc_ids, twins, texts, wanted, strict=True):
                    units = spec.units(text)
                    rolling = Rolling(spec.tokens(text)) if any(x["hot"] for x in asked) else None
                    for x in asked:
                        first, last = x["lo"], x["lo"] + x["more"]
                        if x["hot"]:
                            out += [(g, d, twin, a, place - a, None, b - a, s) for place, a, b, g, s in finer(rolling, first, last, first + x["offset"], level, spec)]
                        else:
                            out.append((x["g"], d, twin, first, x["offset"], spec.cut(units, first, last + w), None, None))
                yield _batch(names, kinds, out)

        parts = materialize(texts.select("doc", "twin", "text", "wanted").mapInArrow(fetch, "g long, doc long, twin long, lo int, offset short, content binary, more short, s long"), "contents")
        cool = parts.where("content is not null").select("g", "doc", "twin", "lo", "offset", "content").dropDuplicates(["g", "doc", "twin", "lo"])
        ends = cool.repartition("g").sortWithinPartitions("g", "doc", "twin", "lo").mapInArrow(compare, f"g long, lead int, {MATCH}")
        if not spec.within:  # what holds for a first segment holds for its other places in the first document
            ends = materialize(ends, "ends")
            again = marked.where(~lead & ~F.col("later")).select("g", F.col("doc").alias("d_"), F.col("twin").alias("t_"), "lo", "f")
            moved = ends.join(again, (ends["g"] == again["g"]) & F.expr("doc = f.doc and twin = f.twin and lead = f.lo"))
            shift = F.col("lo") - F.col("lead")
            found.append(moved.select(F.col("d_").alias("doc"), F.col("t_").alias("twin"), (F.col("start") + shift).alias("start"), (F.col("stop") + shift).alias("stop"), "source", "source_twin", "at"))
        found.append(ends.select(*MATCH_NAMES))
        shared = parts.where("content is null").select("doc", "twin", "lo", "more", "offset", "g", "s").distinct()
        if shared.isEmpty():
            break
        shared = materialize(shared, "finer")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _runs(group: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching stretches of each group; rows sorted by (group, start). First row, start, stop of each."""
    shift = group * (int(stop.max()) + 2)
    reach = np.maximum.accumulate(stop + shift)
    new = np.concatenate([[True], (start + shift)[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(new) - 1]])
    return np.flatnonzero(new), start[new], reach[last] - shift[last]


def repeats(docs: DataFrame, spec: Spec) -> DataFrame:
    """One row a document that has any: doc, twin, starts, stops (its spans, merged), matches (start, stop, source, source_twin, at).

    A match is as long as both documents agree along its diagonal, as far as its parts have the same
    earliest document.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("source", pa.int64()), ("source_twin", pa.int64()), ("at", pa.int32())]))
        for doc_ids, twins, found in rows_of(batches, "doc", "twin", "found", step=512):
            out = []
            for d, twin, rows in zip(doc_ids, twins, found, strict=True):
                start, stop, source, other, at = np.array([(x["start"], x["stop"], x["source"], x["source_twin"], x["at"]) for x in rows], np.int64).T
                order = np.lexsort((start, at - start, other, source))
                start, stop, source, other, at = start[order], stop[order], source[order], other[order], at[order]
                changed = (np.diff(source) != 0) | (np.diff(other) != 0) | (np.diff(at - start) != 0)
                first, a, b = _runs(np.concatenate([[0], np.cumsum(changed)]), start, stop)
                whole = [{"start": x, "stop": y, "source": p, "source_twin": q, "at": z} for x, y, p, q, z in zip(a.tolist(), b.tolist(), source[first].tolist(), other[first].tolist(), at[first].tolist(), strict=True)]
                order = np.argsort(a, kind="stable")
                _, a, b = _runs(np.zeros(len(a), np.int64), a[order], b[order])
                out.append((d, twin, a.tolist(), b.tolist(), whole))
            yield _batch(["doc", "twin", "starts", "stops", "matches"], [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), match], out)

    found = matches(docs, spec).groupBy("doc", "twin").agg(F.collect_list(F.struct(*MATCH_NAMES[2:])).alias("found"))  # a document's own
    return materialize(found.mapInArrow(merge, "doc long, twin long, starts array<int>, stops array<int>, matches array<struct<start:int,stop:int,source:long,source_twin:long,at:int>>"), "repeats")


def repeat_groups(docs: DataFrame, spec: Spec) -> DataFrame:
    """(source, source_twin, at, size, doc, twin, start): all occurrences of each repeat, its first one included, grouped by the first four."""
    m = repeats(docs, spec).select("doc", "twin", F.explode("matches").alias("m"))
    rows = m.select("m.source", "m.source_twin", "m.at", (F.col("m.stop") - F.col("m.start")).alias("size"), "doc", "twin", "m.start")
    first = rows.select("source", "source_twin", "at", "size", F.col("source").alias("doc"), F.col("source_twin").alias("twin"), F.col("at").alias("start"))
    return rows.unionByName(first).distinct()


def repeated_spans(docs: DataFrame, spec: Spec) -> DataFrame:
    """(doc, twin, starts, stops): merged stretches, in tokens, of windows that occur earlier."""
    found = repeats(docs, spec)
    spans = found.select("doc", "twin", "starts", "stops")
    spans._tessera_path = found._tessera_path
    return spans


def with_spans(docs: DataFrame, spans: DataFrame, keep_rows: bool = False) -> DataFrame:
    """Every document with its merged spans (null: none); with ``keep_rows`` also ``row``, the input row."""
    found = broadcast_if_small(spans).withColumnsRenamed({"doc": "d_", "twin": "t_"})
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_rows else []), F.col("doc_id").alias("doc"), twin_of(text).alias("twin"), text.alias("text"))
    return rows.join(found, F.expr("doc = d_ and twin = t_"), "left").drop("d_", "t_", "twin")
