"""Token ids as static range asymmetric numeral system (rANS) shards.

A shard holds up to SHARD_TOKENS ids of consecutive documents. Its ids share one frequency table;
they are cut into independent blocks, each of LANES interleaved coders over one stream of 32-bit
words. Every block's checkpoint (first word, word count, the lanes' states, CRC-32 of states and
words, CRC-32 of its ids) lets any block be decoded and verified on its own; here numpy steps through all blocks
and lanes of a shard at once, and Spark decodes shards in parallel.

Shards are binary cells of a Parquet table (part, shard, part_start, n_docs, n_tokens, blob), so
Spark's committer makes writes of retried tasks whole. Parts are ranges of doc_id in ascending
order; a document's start is its part's base (one total a part) plus its start in the part.

Defined results: null text is an empty text (its end id only); null doc_ids come first; rows that
repeat a doc_id stay together, ordered by text; an empty table gives no shard and an empty result; ids
are kept as unsigned 32-bit numbers.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import ByteEncoder
from .common import documents, kept, materialize, rows_of
from .token_counts import tokenizer_json, version_of

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
MAGIC = b"RANS1\0\0\0"
SCALE_BITS = 20
LOW = 1 << 31
LANES = 128
BLOCK_STEPS = 512
SHARD_TOKENS = 1 << 21


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2**SCALE_BITS."""
    total = 1 << SCALE_BITS
    if len(counts) > total:
        raise ValueError(f"more than {total} different ids in a shard")
    freq = 1 + (counts.astype(np.float64) * ((total - len(counts)) / counts.sum())).astype(np.int64)
    freq[np.argmax(counts)] += total - freq.sum()
    return freq.astype(np.uint64)


def encode_ids(ids: np.ndarray) -> bytes:
    """A shard's blob: header, table, checkpoints, words."""
    n = len(ids)
    if not n:
        return MAGIC + struct.pack("<QIIII", 0, 0, 0, 0, 0)
    if int(ids.max()) < 1 << 22:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        place = np.zeros(len(counts), np.uint32)
        place[symbols] = np.arange(len(symbols))
        slot, counts = place[ids], counts[symbols]
    else:
        symbols, slot, counts = np.unique(ids, return_inverse=True, return_counts=True)
    freq = quantise(counts)
    base = (np.cumsum(freq) - freq).astype(np.uint64)
    blocks = -(-n // (LANES * BLOCK_STEPS))
    steps = -(-n // (LANES * blocks))
    padded = np.full(blocks * steps * LANES, np.argmax(counts), slot.dtype)
    padded[:n] = slot
    grid = padded.reshape(blocks, steps, LANES)
    state = np.full((blocks, LANES), LOW, np.uint64)
    words, sent = np.zeros((blocks, steps, LANES), np.uint32), np.zeros((blocks, steps, LANES), bool)
    shift, scale, room = np.uint64(32), np.uint64(SCALE_BITS), np.uint64(63 - SCALE_BITS)
    for t in range(steps - 1, -1, -1):
        f, b = freq[grid[:, t]], base[grid[:, t]]
        full = state >= (f << room)
        words[:, t], sent[:, t] = state.astype(np.uint32), full
        state = np.where(full, state >> shift, state)
        whole = state // f
        state = (whole << scale) + (state - whole * f) + b
    stream, per_block = words[sent].astype("<u4"), sent.sum(axis=(1, 2))
    ends = np.cumsum(per_block)
    index = b"".join(
        struct.pack("<IIII", int(e - c), int(c), zlib.crc32(state[i].astype("<u8").tobytes() + stream[e - c : e].tobytes()), zlib.crc32(ids[i * steps * LANES : (i + 1) * steps * LANES].astype("<u4").tobytes()))
        for i, (e, c) in enumerate(zip(ends, per_block, strict=True))
    )
    table = zlib.compress(np.diff(symbols.astype("<i8"), prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    return MAGIC + struct.pack("<QIIII", n, blocks, steps, len(symbols), len(table)) + table + index + state.astype("<u8").tobytes() + stream.tobytes()


def decode_ids(blob: bytes, only: list[int] | None = None) -> np.ndarray:
    """The ids of a shard, or of the blocks ``only``; raises ValueError where a checksum differs."""
    if blob[:8] != MAGIC:
        raise ValueError("not a shard")
    n, blocks, steps, kinds, size = struct.unpack_from("<QIIII", blob, 8)
    if not n:
        return np.zeros(0, np.uint32)
    at = 32
    table = np.frombuffer(zlib.decompress(blob[at : at + size]), "<u4")
    symbols, freq = np.cumsum(table[:kinds].astype(np.int64)).astype(np.uint32), table[kinds:].astype(np.uint64)
    base = np.cumsum(freq) - freq
    slot_of = np.repeat(np.arange(kinds, dtype=np.uint32), freq.astype(np.int64))
    at += size
    index = np.frombuffer(blob, "<u4", blocks * 4, at).reshape(blocks, 4).astype(np.int64)
    at += blocks * 16
    states = np.frombuffer(blob, "<u8", blocks * LANES, at).reshape(blocks, LANES)
    stream = np.frombuffer(blob, "<u4", offset=at + blocks * LANES * 8)
    chosen = np.arange(blocks) if only is None else np.array(only, np.int64)
    index, state = index[chosen], states[chosen].astype(np.uint64)
    for (first, count, crc, _), begin in zip(index, state, strict=True):
        if zlib.crc32(begin.astype("<u8").tobytes() + stream[first : first + count].tobytes()) != crc:
            raise ValueError("a block's words are damaged")
    ahead = np.concatenate([stream.astype(np.uint64), [np.uint64(0)]])
    low_bits, scale, shift, low = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32), np.uint64(LOW)
    at_word, out = index[:, 0].copy(), np.empty((len(chosen), steps, LANES), np.uint32)
    for t in range(steps):
        under = state & low_bits
        slot = slot_of[under]
        out[:, t] = slot
        state = freq[slot] * (state >> scale) + under - base[slot]
        need = state < low
        order = np.cumsum(need, axis=1)
        place = np.where(need, at_word[:, None] + order - 1, len(stream))
        state = np.where(need, (state << shift) | ahead[place], state)
        at_word += order[:, -1]
    ids = symbols[out.reshape(len(chosen), -1)]
    parts = [row[: max(0, min(steps * LANES, n - int(i) * steps * LANES))] for i, row in zip(chosen, ids, strict=True)]
    for part, (_, _, _, crc) in zip(parts, index, strict=True):
        if zlib.crc32(part.astype("<u4").tobytes()) != crc:
            raise ValueError("a block's ids are damaged")
    return np.concatenate(parts)


SHARDS = "part int, shard int, part_start long, n_docs long, n_tokens long, docs binary, blob binary"
INDEX = np.dtype([("doc_id", "<i8"), ("n", "<i8"), ("null", "?")])


def write_shards(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Tokenizes, orders by doc_id and writes; returns the stored shards."""
    spark = docs.sparkSession
    text, end = tokenizer_json(tokenizer), np.uint32(end_id)
    version, shared = version_of(text), spark.sparkContext.broadcast(text)  # a file of a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = kept(("ids", version), lambda: ByteEncoder(shared.value)), TaskContext.get().partitionId()
        index, held, size, shard, start = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            docs = np.array(index, INDEX)
            cells = [[part], [shard], [start], [len(docs)], [size], [docs.tobytes()], [encode_ids(np.concatenate(held))]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["part", "shard", "part_start", "n_docs", "n_tokens", "docs", "blob"])

        for doc_ids, texts in rows_of(batches, "doc_id", "text", step=64):
            for d, ids in zip(doc_ids, encoder.many([t or "" for t in texts]), strict=True):
                ids = np.append(ids, end)
                index.append((d or 0, len(ids), d is None))
                held.append(ids)
                size += len(ids)
                if size >= SHARD_TOKENS:
                    yield flush()
                    shard, start = shard + 1, start + size
                    index, held, size = [], [], 0
        if index:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(run, SHARDS), "rans")


def read_shards(shards: DataFrame) -> DataFrame:
    """One row a document, from the stored bytes: doc_id, start, n_tokens, ids."""
    return _read(shards, "ids array<bigint>", lambda ids: ids.astype(np.int64).tolist(), pa.list_(pa.int64()))


def _read(shards: DataFrame, field: str, make, kind: pa.DataType) -> DataFrame:
    name = field.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, starts, docs, blobs in rows_of(batches, "part", "part_start", "docs", "blob", step=1):
            for part, start, listed, blob in zip(parts, starts, docs, blobs, strict=True):
                listed, ids = np.frombuffer(listed, INDEX), decode_ids(blob)
                ends = np.cumsum(listed["n"])
                made = [make(ids[e - n : e]) for e, n in zip(ends, listed["n"], strict=True)]
                cells = [pa.array([part] * len(listed), pa.int32()), pa.array(listed["doc_id"], pa.int64(), mask=listed["null"]), pa.array(start + ends - listed["n"], pa.int64()), pa.array(listed["n"].astype(np.int64)), pa.array(made, kind)]
                yield pa.RecordBatch.from_arrays(cells, ["part", "doc_id", "in_part", "n_tokens", name])

    spark = shards.sparkSession
    totals = sorted(shards.groupBy("part").agg(F.sum("n_tokens")).collect())  # a number a part: at most the number of partitions
    base, bases = 0, []
    for part, n in totals:
        bases.append((part, base))
        base += n
    bases = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    rows = shards.mapInArrow(run, f"part int, doc_id long, in_part long, n_tokens long, {field}")
    return rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("in_part")).alias("start"), "n_tokens", name)


def op3_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(write_shards(documents(spark, sf_dir)), "ids_crc32 bigint", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64())
