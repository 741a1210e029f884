"""Content-defined chunking of media payloads into a deduplicated store.

A payload is cut where a rolling gear hash (``h = (h << 1) + gear[byte]`` over 32 bits, so the last
32 bytes count) has its top bits zero, no sooner than MIN_CHUNK and no later than MAX_CHUNK bytes
after the last cut. Chunks are named by 128 bits of SHA-256. Payloads and chunks are deduplicated by Spark
groupings and joins on their digests, over metadata only:

* ``payload`` rows, one a distinct payload: an ordered manifest (digest and size of every chunk), a
  mark for each chunk that is stored elsewhere, and the bytes of the others;
* ``chunk`` rows, one a chunk that several places share.

So most payloads are read back from one row without any shuffle; only shared chunks are fetched by
a join. Every chunk is verified against its digest, every payload against its own. Both kinds are
one Parquet table in the shared folder, written by Spark's committer.

The stored form that is measured is a payload's manifest followed by its chunks in order; it depends on
the payload alone, not on what else is stored.

Defined results: null text is an empty text, whose payload is 64 zero bytes; a very long text is cut
into as many chunks as it takes and rebuilt whole; repeated rows and copies share one stored payload;
among equal payloads that of the least doc_id is stored (a tie of one doc_id is the same bytes), and a
chunk that several have is stored by the least (payload, place); a null doc_id is kept; extra columns,
whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, documents, join_counted, materialize, release, rows_of

GEAR = np.random.default_rng(1).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)
CUT_BITS = 11
MIN_CHUNK, MAX_CHUNK = 512, 16384
UNIT = 64
MAGIC = b"CDC1"
#: Digest, size.
ENTRY = struct.Struct("<16sI")


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes with zeros up to a positive multiple of 64."""
    data = (text or "").encode()
    return data + b"\0" * (-len(data) % UNIT if data else UNIT)


def gear_hashes(data: bytes) -> np.ndarray:
    """The rolling hash after each byte, by doubling the window five times."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        wider = h.copy()
        wider[k:] += h[:-k] << np.uint32(k)
        h = wider
    return h


def cut(data: bytes) -> list[bytes]:
    """The chunks of a payload, in order."""
    out, start = [], 0
    if len(data) > MIN_CHUNK:
        for at in (np.flatnonzero(gear_hashes(data) >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist():
            while at - start > MAX_CHUNK:
                out.append(data[start : start + MAX_CHUNK])
                start += MAX_CHUNK
            if at - start >= MIN_CHUNK:
                out.append(data[start:at])
                start = at
    while len(data) - start > MAX_CHUNK:
        out.append(data[start : start + MAX_CHUNK])
        start += MAX_CHUNK
    if start < len(data):
        out.append(data[start:])
    return out


def digest(data: bytes) -> bytes:
    """A name: the first 128 bits of SHA-256."""
    return hashlib.sha256(data).digest()[:16]


def feature(data: bytes) -> str:
    """Statistics of the payload as 8-bit samples."""
    x = np.frombuffer(data, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    return f"n={len(x)};mean={x.mean():.4f};dev={x.std():.4f};entropy={-(p * np.log2(p)).sum():.4f};peak={int(x.max())};crossings={crossings}"


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for doc_ids, texts in rows_of(batches, "doc_id", "text"):
        data = [payload_of(t) for t in texts]
        lists = [[digest(c) for c in cut(d)] for d in data]
        cells = [pa.array(doc_ids, pa.int64()), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(map(digest, data), pa.binary()), pa.array(lists, pa.list_(pa.binary()))]
        yield pa.RecordBatch.from_arrays(cells, ["doc_id", "n_bytes", "payload", "chunks"])


STORE = "kind string, name binary, manifest binary, elsewhere binary, bytes binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads compressed before they are dealt out."""
    pack = zstandard.ZstdCompressor(level=6)
    for doc_ids, texts in rows_of(batches, "doc_id", "text"):
        data = [payload_of(t) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(map(digest, data), pa.binary()), pa.array(map(pack.compress, data), pa.binary())], ["doc_id", "payload", "packed"])


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Store rows of the documents that are the first of their payload. ``shared``: places in the chunk table, ``owned``: those that this payload writes."""
    unpack = zstandard.ZstdDecompressor()
    for names, packed, shared, owned in rows_of(batches, "payload", "packed", "shared", "owned"):
        rows = []
        for name, data, elsewhere, mine in zip(names, packed, shared, owned, strict=True):
            data = unpack.decompress(data)
            elsewhere, mine, inline, manifest, chunks = set(elsewhere or ()), set(mine or ()), [], [MAGIC], cut(data)
            for i, c in enumerate(chunks):
                manifest.append(ENTRY.pack(digest(c), len(c)))
                if i in mine:
                    rows.append(("chunk", digest(c), None, None, c))
                if i not in elsewhere:
                    inline.append(c)
            rows.append(("payload", name, b"".join(manifest), bytes(i in elsewhere for i in range(len(chunks))), b"".join(inline)))
        kinds = [pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        cells = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["kind", "name", "manifest", "elsewhere", "bytes"])


def write_store(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Returns (recipes, payloads, places, store).

    doc_id → payload digest; the distinct payloads with their number of rows; (payload, place,
    digest, n) of chunks that ``n`` places share; the stored rows.
    """
    recipes = materialize(docs.select("doc_id", "text").mapInArrow(_recipes, "doc_id long, n_bytes long, payload binary, chunks array<binary>"), "recipes")
    payloads = materialize(recipes.groupBy("payload").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("n"), F.first("chunks").alias("chunks")), "payloads")
    every = payloads.select("payload", F.posexplode("chunks").alias("place", "digest"))
    shared = every.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("payload", "place")).alias("first")).where("n > 1")
    shared = materialize(shared, "shared")
    places = join_counted(every, shared, "digest", shared).select("payload", "place", "digest", "n", F.expr("first.payload = payload and first.place = place").alias("owns"))
    places = materialize(places, "places")
    by_payload = places.groupBy("payload").agg(F.collect_list("place").alias("shared"), F.collect_list(F.when(F.col("owns"), F.col("place"))).alias("owned"))
    plan = materialize(payloads.select("payload", "owner").join(by_payload, "payload", "left").withColumnRenamed("payload", "payload_"), "store-plan")
    packed = docs.select("doc_id", "text").mapInArrow(_packed, "doc_id long, payload binary, packed binary")
    store = packed.join(plan.hint("merge"), F.expr("payload = payload_ and doc_id <=> owner")).mapInArrow(_stored, STORE)
    store = materialize(store, "store", ["kind"])
    release(shared)
    release(plan)
    return recipes, payloads, places, store


def read_payloads(places: DataFrame, store: DataFrame) -> DataFrame:
    """(name, manifest, elsewhere, bytes, fetched) of every stored payload, with the shared chunks that it needs."""
    stored = store.where("kind = 'payload'").select("name", "manifest", "elsewhere", "bytes")
    chunks = store.where("kind = 'chunk'").select(F.col("name").alias("digest"), F.col("bytes").alias("chunk")).dropDuplicates(["digest"])
    needed = join_counted(places.select("payload", "digest").distinct(), chunks, "digest", places)
    fetched = needed.groupBy("payload").agg(F.collect_list(F.struct("digest", "chunk")).alias("fetched"))  # a payload's own chunks
    borrows = materialize(places.select("payload").distinct(), "borrowers")
    whole = stored.join(broadcast_if_small(borrows), F.col("name") == F.col("payload"), "left_anti").withColumn("fetched", F.lit(None).cast("array<struct<digest:binary,chunk:binary>>"))
    part = stored.join(broadcast_if_small(borrows), F.col("name") == F.col("payload"), "left_semi").join(fetched, F.col("name") == F.col("payload")).drop("payload")
    return whole.unionByName(part)


def rebuild(name: bytes, manifest: bytes, elsewhere: bytes, inline: bytes, fetched: dict[bytes, bytes]) -> bytes:
    """The payload's bytes; raises ValueError where a chunk or the whole differs from its digest."""
    if manifest[:4] != MAGIC:
        raise ValueError("not a manifest")
    parts, at = [], 0
    for (sha, size), away in zip(ENTRY.iter_unpack(manifest[4:]), elsewhere, strict=True):
        c = fetched[sha] if away else inline[at : at + size]
        at += 0 if away else size
        if len(c) != size or digest(c) != sha:
            raise ValueError("a chunk is damaged")
        parts.append(c)
    data = b"".join(parts)
    if digest(data) != name:
        raise ValueError("a payload is damaged")
    return data


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for names, manifests, marks, inlines, lists in rows_of(batches, "name", "manifest", "elsewhere", "bytes", "fetched"):
        out = []
        for name, manifest, elsewhere, inline, fetched in zip(names, manifests, marks, inlines, lists, strict=True):
            data = rebuild(name, manifest, elsewhere, inline, {f["digest"]: f["chunk"] for f in fetched or ()})
            form = hashlib.sha256(manifest)
            form.update(data)
            out.append((name, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(manifest) + len(data), form.hexdigest(), feature(data), (len(manifest) - 4) // ENTRY.size))
        kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        cells = list(zip(*out, strict=True)) or [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["payload", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"])


def op4_chunk_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipes, payloads, places, store = write_store(documents(spark, sf_dir))
    measured = read_payloads(places, store).mapInArrow(_measured, "payload binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long")
    measured = materialize(measured.dropDuplicates(["payload"]), "measured")
    return join_counted(recipes.select("doc_id", "n_bytes", "payload"), measured, "payload", payloads).drop("payload")
