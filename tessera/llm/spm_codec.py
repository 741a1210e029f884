"""SentencePiece encoding and decoding with byte offsets.

A text is normalised as the model's compiled character map says (longest prefix first), with a record
of the source byte that each normalised byte comes from. The normalised text is encoded by the
library with the same model and no normalising of its own; the pieces' lengths in normalised bytes are
then summed and projected through the record, so every piece gets a span of original bytes. Tests
compare ids and spans with the library's own normalising, for this model and for ones with a map.

Where no piece joins text across the start of a space run (checked on the model), the runs are encoded
one by one and memoised: what the library gives for a run does not depend on its neighbours. A model
with user-defined symbols, which the library matches while it normalises, is encoded by the library.

Defined results: null text counts as empty; an empty text gives begin and end id only and decodes to
an empty text; a very long text is encoded whole; repeated rows each get a row, with equal values for
equal texts, so there are no ties; a null doc_id is kept; extra columns, whatever their names, are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Memo, documents, rows_of

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Kinds of pieces and models in the model file.
UNKNOWN_PIECE, CONTROL_PIECE, USER_PIECE, BYTE_PIECE, BPE = 2, 3, 4, 6, 2


def model_bytes(name_or_path: str) -> bytes:
    """The model file, read once on the driver; a bare name is looked up among the public tokenizers."""
    if "/" not in name_or_path:
        import public_tokenizers

        name_or_path = public_tokenizers.path(name_or_path)
    with open(name_or_path, "rb") as f:
        return f.read()


class CharMap:
    """A compiled character map: a double-array trie of source strings, then their replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.targets = blob[4 + size :]
        #: Bytes that an entry begins with.
        self.leads = np.array([self._child(self._step(self.units[0]), b) is not None for b in range(256)]) if self.units else np.zeros(256, bool)

    @staticmethod
    def _step(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _child(self, node: int, byte: int) -> int | None:
        node ^= byte
        return node if node < len(self.units) and (self.units[node] & 0x800000FF) == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(source bytes, replacement) of the longest entry that ``data`` has at ``at``."""
        if not self.units:
            return None
        found, node = None, self._step(self.units[0])
        for i in range(at, len(data)):
            child = self._child(node, data[i])
            if child is None:
                break
            node = child ^ self._step(self.units[child])
            if self.units[child] >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.targets[start : self.targets.index(b"\0", start)])
        return found

    def apply(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The mapped bytes and the source byte that each comes from; stretches without an entry are copied."""
        source, at, parts, places = np.frombuffer(data, np.uint8), 0, [], []
        for i in np.flatnonzero(self.leads[source]).tolist():
            hit = self.longest(data, i) if i >= at else None
            if hit:
                parts += [source[at:i], np.frombuffer(hit[1], np.uint8)]
                places += [np.arange(at, i), np.full(len(hit[1]), i)]
                at = i + hit[0]
        return np.concatenate([*parts, source[at:]]), np.concatenate([*places, np.arange(at, len(source))]).astype(np.int64)


class OffsetCodec:
    def __init__(self, model: bytes) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as schema

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = schema.ModelProto()
        proto.ParseFromString(model)
        rules, trainer = proto.normalizer_spec, proto.trainer_spec
        self.map, self.dummy, self.squeeze, self.escape = CharMap(rules.precompiled_charsmap), rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces
        self.suffix = trainer.treat_whitespace_as_suffix
        pieces = [(p.piece, p.type) for p in proto.pieces]
        self.lengths = np.array([1 if kind == BYTE_PIECE else 0 if kind in (CONTROL_PIECE, UNKNOWN_PIECE) else len(text.encode()) for text, kind in pieces], np.int64)
        self.bos, self.eos = self.lib.bos_id(), self.lib.eos_id()
        self.own = not any(kind == USER_PIECE for _, kind in pieces)
        rules.precompiled_charsmap, rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces = b"", False, False, False
        #: The same model without normalising.
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        #: The conditions for encoding run by run, checked on the model.
        self.by_run = trainer.model_type == BPE and self.escape and not self.suffix and trainer.byte_fallback and self.lib.piece_to_id(SPACE) != self.lib.unk_id() and not any(SPACE in text.lstrip(SPACE) for text, _ in pieces)
        self.words = Memo(lambda word: self.plain.encode(SPACE + word))
        self.runs = Memo(self.plain.encode)

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each of them and the end, the source byte it comes from."""
        data, space = text.encode(), SPACE.encode() if self.escape else b" "
        if not self.map.units and not self.squeeze and not self.suffix:
            source = np.frombuffer(data, np.uint8)
            wide = np.where(source == 32, len(space), 1)
            head = len(space) if self.dummy and data else 0
            align = np.concatenate([np.zeros(head, np.int64), np.repeat(np.arange(len(data)), wide), [len(data)]])
            return (space if head else b"") + data.replace(b" ", space), align
        out, align = self.map.apply(data)
        if self.squeeze:
            gap = out == 32
            keep = ~gap | np.concatenate([[False], ~gap[:-1]])[: len(out)]
            out, align = out[keep], align[keep]
        head, tail = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.dummy and len(out) and not self.suffix:
            head = align[:1]
        if self.dummy and len(out) and self.suffix:
            tail = np.array([len(data)])
        out, align = np.concatenate([np.full(len(head), 32, np.uint8), out, np.full(len(tail), 32, np.uint8)]), np.concatenate([head, align, tail])
        align = np.repeat(align, np.where(out == 32, len(space), 1))
        made = out.tobytes().replace(b" ", space)
        if self.squeeze and not self.suffix:
            while made.endswith(space):
                made = made[: -len(space)]
        align = align[: len(made)]
        return made, np.append(align, len(data))

    def ids(self, normal: str) -> list[int]:
        """Ids of a normalised text, without begin and end."""
        if not self.by_run:
            return self.plain.encode(normal)
        words = normal.split(SPACE)
        if not words[0] and "" not in words[1:]:
            return list(chain.from_iterable(map(self.words.__getitem__, words[1:])))
        return list(chain.from_iterable(map(self.runs.__getitem__, re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", normal))))

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids without begin and end, and the start and end byte of each piece in the text (half-open)."""
        if not text:
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not self.own:
            pieces = self.lib.encode(text, return_type="proto").pieces
            return [p.id for p in pieces], np.array([p.begin for p in pieces], np.int64), np.array([p.end for p in pieces], np.int64)
        normal, align = self.normalise(text)
        ids = self.ids(normal.decode())
        lengths = self.lengths[ids] if ids else np.zeros(0, np.int64)
        if int(lengths.sum()) != len(align) - 1:  # unknown characters: take the library's surfaces
            lengths = np.array([p.end - p.begin for p in self.plain.encode(normal.decode(), return_type="proto").pieces], np.int64)
        ends = np.cumsum(lengths)
        return ids, align[ends - lengths], align[ends]

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)


def _over(docs: DataFrame, model: str, schema: str, make: Callable[[OffsetCodec, list[str]], dict]) -> DataFrame:
    """doc_id and the columns that ``make`` gives for whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(model))  # half a MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = OffsetCodec(shared.value)
        for doc_ids, texts in rows_of(batches, "doc_id", "text"):
            columns = {"doc_id": pa.array(doc_ids, pa.int64())} | make(codec, [t or "" for t in texts])
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {schema}")


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids (with begin and end), starts, ends (byte spans of the inner pieces) and the decoded text."""

    def make(codec: OffsetCodec, texts: list[str]) -> dict:
        found = [codec.encode(t) for t in texts]
        ids = [[codec.bos, *x, codec.eos] for x, _, _ in found]
        longs = pa.list_(pa.int64())
        return {"ids": pa.array(ids, pa.list_(pa.int32())), "starts": pa.array([a for _, a, _ in found], longs), "ends": pa.array([b for _, _, b in found], longs), "decoded": pa.array([codec.decode(x) for x in ids], pa.string())}

    return _over(docs, model, "ids array<int>, starts array<bigint>, ends array<bigint>, decoded string", make)


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Digests of what :func:`encode_documents` returns, taken beside the encoding so that ids and spans need not leave the task."""

    def make(codec: OffsetCodec, texts: list[str]) -> dict:
        out = []
        for text in texts:
            inner, starts, ends = codec.encode(text)
            ids = [codec.bos, *inner, codec.eos]
            out.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest(), zlib.crc32(np.stack([starts, ends]).astype("<i8").tobytes())))
        n, a, b, c = zip(*out, strict=True) if out else ((), (), (), ())
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string()), "spans_crc32": pa.array(c, pa.int64())}

    return _over(docs, model, "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long", make)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
