"""Near duplicates: MinHash bands find candidates, odd sketches and exact set sizes confirm them.

1. A document's set is its distinct shingles of ``size`` words (64-bit hashes). Documents of one set
   form a class, stood for by its least doc_id; copies are never paired.
2. 128 MinHash samples in 32 bands of 4 place the classes in buckets; a pair of similarity 0.8
   shares no bucket with probability 5e-8. The samples are also folded into a parity bitmap (odd
   sketch), whose XOR population count estimates the similarity.
3. Classes connected by shared buckets form a family; its sets go to units of bounded size.
4. In a unit, a set looks for partners only among sets that share one of its rarest shingles, as
   many as a partner of similarity 0.8 cannot all miss (prefix filter). Pairs that the odd sketches
   estimate below ``LEAST_ESTIMATE`` go, the rest are confirmed by exact intersection and union. Sets
   that are already connected are not compared. A unit returns a spanning forest of its links.
5. A family beyond ``UNIT_BYTES`` is first linked inside blocks, then through one set of each
   component found there. What the family's largest component holds needs no more comparing with
   itself; the sets outside it ("rest") meet all others either block by block, or, where the rest is
   large (a family held together by boilerplate), by the shingles of their prefixes, of which only
   those that two components share are used. So sets are not copied to pairs of blocks.
6. Connected components of all links give the result.

No pair list of a group is ever made, and nothing is capped or collected to the driver.

Defined results: null or blank text has an empty set and is linked with nothing; a very long text is
one set of all its shingles; rows that repeat a doc_id are one node, so a link of either holds for both
(of equal texts the least doc_id stands for the class, so ties do not matter); a row without doc_id
takes part in no link, has a null component and is kept; extra columns, whatever their names, are not
read and :func:`keep_first` returns them as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Memo, broadcast_if_small, documents, join_counted, materialize, release, rows_of
from .graph import Forest, components

SHINGLE = 4
SIMILAR, OF = 80, 100
SAMPLES, BANDS = 128, 32
SKETCH_BITS = 1024
#: Estimates of 0.8-similar pairs lie around 0.8 with a standard deviation of about 0.05 (tests measure it); this is over 7 below.
LEAST_ESTIMATE = 0.36
UNIT_BYTES = 8 << 20
#: The rest of a family is copied to each of its blocks if that makes at most so many times the family's bytes.
MOST_COPIES = 8

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_RNG = np.random.default_rng(20)
_A = (_RNG.integers(0, 1 << 32, SAMPLES, np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_B = _RNG.integers(0, 1 << 32, SAMPLES, np.uint64).astype(np.uint32)[:, None]
_MIX = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_COUNTS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[0]
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sorted distinct shingle hashes of a text."""

    def __init__(self, size: int = SHINGLE) -> None:
        self.size, self.words = size, Memo(xxhash.xxh3_64_intdigest)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().translate(LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.size:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = len(h) - self.size + 1
        out = np.zeros(n, np.uint64)
        for i in range(self.size):
            out = mixed(out * _MIX[1] + h[i : i + n])
        return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(h), 1024):
        np.minimum(low, (_A * h[None, at : at + 1024] + _B).min(axis=1), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    rows, key = low.reshape(BANDS, -1).astype(np.uint64), np.arange(BANDS, dtype=np.uint64)
    for i in range(rows.shape[1]):
        key = mixed(key * _MIX[2] + rows[:, i])
    return key.view(np.int64)


def odd_sketch(low: np.ndarray) -> bytes:
    """Bit i is the parity of the number of samples that hash to i."""
    at = mixed(low.astype(np.uint64) * _MIX[3] + np.arange(SAMPLES, dtype=np.uint64)) >> np.uint64(54)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def estimates(differ: np.ndarray) -> np.ndarray:
    """Similarities as the numbers of bits tell them in which two odd sketches differ."""
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(np.maximum(1e-9, 1 - 2 * differ / SKETCH_BITS))


def estimated_similarity(a: bytes, b: bytes) -> float:
    return float(estimates(np.array(_COUNTS[np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)].sum(dtype=np.int64))))


def _sketches(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for doc_ids, texts in rows_of(batches, "doc_id", "text"):
            n, key, band = [], [], []
            for text in texts:
                s = shingler(text)
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                band.append(bands(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(band, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "key", "bands"])

    return run


def _sets(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for doc_ids, texts in rows_of(batches, "doc_id", "text", step=64):
            sets = [shingler(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([odd_sketch(signature(s)) for s in sets], pa.binary())], ["node", "shingles", "sketch"])

    return run


def prefix_length(n: int) -> int:
    """So many shingles of a set of ``n``, in any order common to all sets, meet those of each similar set."""
    return n - -(-SIMILAR * n // OF) + 1


def links_of(sets: list[np.ndarray], sketches: np.ndarray, left: np.ndarray, right: np.ndarray, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets marked ``left`` and sets marked ``right`` (a set may be both), beyond the components ``known``."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    every = np.concatenate(sets)
    _, token, freq = np.unique(every, return_inverse=True, return_counts=True)
    order = np.argsort(token, kind="stable")
    posting, starts = owner[order], np.concatenate([[0], np.cumsum(freq)])
    ends = np.cumsum(sizes)
    forest, found = Forest(len(sets)), []
    if known is not None:
        _, first, which = np.unique(known, return_index=True, return_inverse=True)
        forest.up[:] = first[which]
    for x in np.flatnonzero(left):
        mine = token[ends[x] - sizes[x] : ends[x]]
        rare = mine[np.argsort(freq[mine], kind="stable")[: prefix_length(sizes[x])]]
        rare = rare[freq[rare] > 1]
        if not len(rare):
            continue
        near = np.unique(np.concatenate([posting[starts[t] : starts[t + 1]] for t in rare]))
        near = near[(near != x) & right[near] & (OF * np.minimum(sizes[near], sizes[x]) >= SIMILAR * np.maximum(sizes[near], sizes[x]))]
        if not len(near):
            continue
        up = forest.flat()
        near = near[up[near] != up[x]]
        near = near[estimates(_COUNTS[sketches[near] ^ sketches[x]].sum(axis=1, dtype=np.int64)) >= LEAST_ESTIMATE]
        if not len(near):
            continue
        if len(near) > 8:
            shared = mine[freq[mine] > 1]
            both = np.bincount(np.concatenate([posting[starts[t] : starts[t + 1]] for t in shared]), minlength=len(sets))[near]
        else:
            both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for y in near])
        for y in near[OF * both >= SIMILAR * (sizes[near] + sizes[x] - both)]:
            if forest.join(int(x), int(y)):
                found.append((int(x), int(y)))
    return found


def _unit(table: pa.Table) -> pa.Table:
    """Links of a unit's sets; ``side`` is 1 (left), 2 (right) or 3, ``part`` the component that is known already."""
    nodes = table["node"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
    sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(sets), -1)
    side = table["side"].to_numpy()
    found = links_of(sets, sketches, (side & 1) > 0, (side & 2) > 0, table["part"].to_numpy()) if len(sets) > 1 else []
    return pa.table({"u": pa.array([nodes[a] for a, _ in found], pa.int64()), "v": pa.array([nodes[b] for _, b in found], pa.int64())})


UNIT = ("family", "token", "block", "side", "part", "node", "shingles", "sketch")


def _links(units: DataFrame) -> DataFrame:
    return units.select(*UNIT).groupBy("family", "token", "block").applyInArrow(_unit, "u long, v long")


def _blocks(size: Column) -> Column:
    return (F.floor(size / UNIT_BYTES) + 1).cast("int")


def _tokens_of_prefix(common: np.ndarray) -> Callable:
    """(family, token, node, part, side, bytes) of the shingles of each set's prefix; the order of shingles puts ``common`` ones last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["family", "token", "node", "part", "side", "bytes"]
        for families, nodes, parts, sides, sets in rows_of(batches, "family", "node", "part", "side", "shingles", step=64):
            sets = [np.frombuffer(s, np.uint64) for s in sets]
            picked = []
            for s in sets:
                often = np.isin(s, common, assume_unique=True)
                picked.append(np.concatenate([s[~often], s[often]])[: prefix_length(len(s))])
            n = [len(x) for x in picked]
            cells = [np.repeat(np.array(families, np.int64), n), np.concatenate(picked).view(np.int64), *[np.repeat(np.array(x, np.int64), n) for x in (nodes, parts, sides, [s.nbytes for s in sets])]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], names)

    return run


def _all_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (sets,) in rows_of(batches, "shingles", step=64):
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.frombuffer(s, np.uint64) for s in sets]).view(np.int64), pa.int64())], ["token"])


def _common_tokens(sets: DataFrame) -> np.ndarray:
    """Shingles of the most sets, fewer than BROADCAST_ROWS / 8 of them; which ones only decides how large units get."""
    counts = materialize(sets.mapInArrow(_all_tokens, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 64"), "tokens")
    least = 64
    while counts.where(F.col("n") > least).count() > BROADCAST_ROWS // 8:
        least *= 4
    found = counts.where(F.col("n") > least).select("token").toPandas()["token"].to_numpy(np.int64).view(np.uint64)
    release(counts)
    return np.sort(found)


def _large_families(sets: DataFrame, weight: DataFrame) -> DataFrame:
    """Links of families that one unit cannot hold; ``weight`` has their bytes."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    none, both, size = F.lit(None).cast("long").alias("token"), F.lit(3).cast("long"), F.octet_length("shingles")
    blocked = sets.join(weight.select("family", "bytes", _blocks(F.col("bytes")).alias("blocks")), "family").withColumn("block", own)
    inside = materialize(_links(blocked.select("*", none, both.alias("side"), F.col("node").alias("part"))), "links")
    parts = materialize(components(inside), "parts")
    heads = sets.join(parts.where("node = component").select("node"), "node", "left_semi")
    head_blocks = heads.groupBy("family").agg(_blocks(F.sum(size)).alias("blocks"))
    heads = heads.join(head_blocks, "family").withColumn("block", own)
    across = materialize(_links(heads.select("*", none, both.alias("side"), F.col("node").alias("part"))), "links")
    parts = materialize(components(inside.unionAll(across)), "parts")
    named = blocked.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    by_part = named.groupBy("family", "part").agg(F.sum(size).alias("held"))
    main = by_part.groupBy("family").agg(F.max_by("part", F.struct("held", "part")).alias("main"), F.max("held").alias("held"))
    copies = (F.col("bytes") - F.col("held")) * F.col("blocks")
    plan = materialize(weight.select("family", "bytes", _blocks(F.col("bytes")).alias("blocks")).join(main, "family").select("family", "main", (copies <= MOST_COPIES * F.col("bytes")).alias("few")), "plan")
    named = materialize(named.drop("bytes", "component").join(plan, "family").withColumn("side", F.when(F.col("part") == F.col("main"), 2).otherwise(3).cast("long")), "sided")

    def spread(rows: DataFrame) -> DataFrame:
        """Rows in the ``block`` of their own on the right, and those outside the main component in every other one on the left."""
        every = F.when(F.col("side") == 3, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
        rows = rows.withColumn("at", F.explode(every))
        return rows.withColumn("side", F.when(F.col("at") != F.col("block"), F.lit(1).cast("long")).otherwise(F.col("side"))).withColumn("block", F.col("at"))

    found = inside.unionAll(across).unionAll(_links(spread(named.where("few")).withColumn("token", none)))
    loose = named.where("not few")
    if loose.isEmpty():
        return found
    tokens = materialize(loose.mapInArrow(_tokens_of_prefix(_common_tokens(loose)), "family long, token long, node long, part long, side long, bytes long"), "prefixes")
    groups = tokens.groupBy("family", "token").agg(F.min("part").alias("low"), F.max("part").alias("high"), _blocks(F.sum("bytes")).alias("blocks")).where("low <> high")
    routes = tokens.join(groups.select("family", "token", "blocks"), ["family", "token"]).withColumn("block", own).select("token", "node", "side", "blocks", "block")
    return found.unionAll(_links(spread(loose.drop("side", "blocks", "block").join(routes, "node"))))


def link_components(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; sets are of shingles of ``size`` words."""
    sketched = materialize(docs.select("doc_id", "text").mapInArrow(_sketches(size), "doc_id long, n_shingles long, key binary, bands array<bigint>"), "sketches")
    real = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(real.groupBy("key").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")), "classes")
    stands = real.select("key", F.col("doc_id").alias("node"), "bands").join(classes, ["key", "node"], "left_semi")
    placed = stands.select("node", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("node").alias("v"), F.max("node").alias("w")).where("v < w").select("bucket", "v")
    touching = placed.join(shared, "bucket").where("node <> v").select(F.col("node").alias("u"), "v").distinct()
    family = materialize(components(touching), "families")
    wanted = broadcast_if_small(family)
    sets = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("node"), "left_semi").mapInArrow(_sets(size), "node long, shingles binary, sketch binary")
    sets = materialize(sets.join(family.withColumnRenamed("component", "family"), "node"), "sets")
    weight = materialize(sets.groupBy("family").agg(F.sum(F.octet_length("shingles")).alias("bytes")).where(F.col("bytes") > UNIT_BYTES), "large-families")
    every = sets.join(broadcast_if_small(weight), "family", "left_anti")
    links = _links(every.select("*", F.lit(None).cast("long").alias("token"), F.lit(0).alias("block"), F.lit(3).cast("long").alias("side"), F.col("node").alias("part")))
    if not weight.isEmpty():
        large = sets.join(broadcast_if_small(weight), "family", "left_semi")
        links = links.unionAll(_large_families(large, weight))
    groups = materialize(components(links), "groups")
    release(sets)
    named = materialize(classes.join(groups, "node", "left").select("key", F.coalesce("component", "node").alias("component_id")), "named")
    out = sketched.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key"))
    lone = out.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return join_counted(out.where("n_shingles > 0 and doc_id is not null"), named, "key", classes).select("doc_id", "n_shingles", "component_id").unionAll(lone)


def keep_first(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One document of each group stays, in the input's columns; the least doc_id."""
    gone = materialize(link_components(docs, size).where("component_id < doc_id").select("doc_id").distinct(), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    gone = broadcast_if_small(gone).select(F.col("doc_id").alias("gone"))
    return rows.join(gone, F.col("row.doc_id") == F.col("gone"), "left_anti").select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op2_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link_components(documents(spark, sf_dir))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


OP2_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), g as (
  select distinct doc_id, md5(array_to_string(w[p:p + 3], ' ')) as h from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) as p from d where len(w) > 0)
), n as (select doc_id, count(*) as n from g group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as k from g a join g b on a.h = b.h and a.doc_id > b.doc_id group by 1, 2),
links as (select x, y from pairs p join n a on p.x = a.doc_id join n b on p.y = b.doc_id where 100 * k >= 80 * (a.n + b.n - k)),
both_ways as (select x, y from links union all select y, x from links),
reach(doc_id, c) as (select doc_id, doc_id from d union select r.doc_id, l.y from reach r join both_ways l on r.c = l.x)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, r.c as component_id, d.doc_id = r.c as kept
from d left join n using (doc_id) join (select doc_id, min(c) as c from reach group by doc_id) r using (doc_id)
"""
