"""Byte-level BPE of many texts by the tokenizers library, which merges each distinct pre-token once.

On whole texts the library spends its time splitting and looking up the same words again. Here a
batch's texts are split by arrays of code points, pre-tokens are looked up in a table with exact keys,
and only those that the table lacks go to the library (the same file, told not to split again). The
split is that of the file's byte-level pre-tokenizer, so ids are the library's own:

* which class a character has (letter, number, space, other) is asked of the library, once a character;
* runs of one class are pre-tokens; a blank joins the run behind it; of a run of spaces before a text's
  next word, the last is apart; ``'s 't 're 've 'm 'll 'd`` behind no blank are apart.

A file of another kind, and any text with an added token's string in it, is encoded whole by the
library. So is, as a check that raises on a difference, every text whose CRC-32 is divisible by
``CHECK_EVERY``; which ones does not depend on the run.
"""

from __future__ import annotations

import json
import zlib
from itertools import chain

import numpy as np

CHECK_EVERY = 256
LETTER, NUMBER, OTHER, SPACE, UNKNOWN = 0, 1, 2, 3, 255
#: Pre-tokens of up to so many bytes have exact keys of 16 bytes: their bytes, zeros, their length.
KEY_BYTES = 15
SLOT_BITS = 21
MOST_ENTRIES = 1 << 20
#: Texts are split so many characters at a time (a longer one alone).
BATCH_CHARS = 1 << 18

_LOW_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


class Pieces:
    """Pre-token → ids, each learned from the library once; starts afresh when full, so its memory is bounded."""

    def __init__(self, library) -> None:
        self.library = library
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros((1 << SLOT_BITS, 2), np.uint64)  # no key is zero: its length is not
        self.entry = np.full(1 << SLOT_BITS, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.n, self.used = 0, 0
        self.first, self.count, self.pool = np.zeros(MOST_ENTRIES + 1, np.int64), np.zeros(MOST_ENTRIES + 1, np.int64), np.zeros(1 << 16, np.uint32)

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        made = [e.ids for e in self.library.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        counts = np.fromiter(map(len, made), np.int64, len(made))
        new, total = slice(self.n, self.n + len(made)), int(counts.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(made), np.uint32, total)
        self.count[new], self.first[new] = counts, self.used + np.cumsum(counts) - counts
        self.n, self.used = self.n + len(made), self.used + total
        return np.arange(new.start, new.stop, dtype=np.int32)

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        h = (keys[:, 0] ^ (keys[:, 1] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 where there is none."""
        found, left, at = np.full(len(keys), -1, np.int32), np.arange(len(keys)), self._slots(keys)
        while len(left):
            held = self.entry[at]
            hit = (self.keys[at] == keys[left]).all(axis=1)
            found[left[hit]] = held[hit]
            more = ~hit & (held >= 0)
            left, at = left[more], (at[more] + 1) & ((1 << SLOT_BITS) - 1)
        return found

    def entries(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
        """Entry of each piece ``data[start:end]``; None if there are too many new ones to hold."""
        size = ends - starts
        short = size <= KEY_BYTES
        words = np.ndarray((len(data) + 1,), "<u8", data + b"\0" * 16, strides=(1,))
        a, n = starts[short], size[short]
        keys = np.empty((len(a), 2), np.uint64)
        keys[:, 0] = words[a] & _LOW_BYTES[np.minimum(n, 8)]
        keys[:, 1] = np.where(n > 8, words[np.minimum(a + 8, len(data))] & _LOW_BYTES[np.maximum(n - 8, 0)], np.uint64(0)) | (n.astype(np.uint64) << np.uint64(56))
        found = self._find(keys)
        out = np.empty(len(starts), np.int32)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            pair = np.ascontiguousarray(keys[missing]).view([("a", "<u8"), ("b", "<u8")]).ravel()
            order = np.lexsort((pair["b"], pair["a"]))
            fresh = np.concatenate([[True], pair[order[1:]] != pair[order[:-1]]])
            which, place = order[fresh], np.empty(len(pair), np.int64)
            place[order] = np.cumsum(fresh) - 1
            new = keys[missing[which]]
            if self.n + len(new) > MOST_ENTRIES:
                return None
            at = missing[which]
            added = self._add([data[x:y] for x, y in zip(a[at].tolist(), (a[at] + n[at]).tolist(), strict=True)])
            left, slot = np.arange(len(new)), self._slots(new)
            while len(left):  # of those that want a free slot the last one gets it, the others and the rest try the next
                free = self.entry[slot] < 0
                self.entry[slot[free]] = added[left[free]]
                got = self.entry[slot] == added[left]
                self.keys[slot[got]] = new[left[got]]
                left, slot = left[~got], (slot[~got] + 1) & ((1 << SLOT_BITS) - 1)
            found[missing] = added[place]
        out[short] = found
        if not short.all():
            pieces = [data[x:y] for x, y in zip(starts[~short].tolist(), ends[~short].tolist(), strict=True)]
            new = list(dict.fromkeys(p for p in pieces if p not in self.long))
            if self.n + len(new) > MOST_ENTRIES:
                return None
            if new:
                self.long.update(zip(new, self._add(new).tolist(), strict=True))
            out[~short] = [self.long[p] for p in pieces]
        return out


class ByteEncoder:
    def __init__(self, text: str) -> None:
        import tokenizers

        spec = json.loads(text)
        pre = spec.get("pre_tokenizer") or {}
        self.library = self._load(text)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: Whether texts may be split here: the file's only pre-tokenizer is a plain byte-level one.
        self.plain = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec["model"].get("dropout")
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        if self.plain:
            whole = self._load(json.dumps(spec | {"added_tokens": [], "post_processor": None}))
            whole.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.split, self.pieces = self.library.pre_tokenizer, Pieces(whole)

    @staticmethod
    def _load(text: str):
        import tokenizers

        found = tokenizers.Tokenizer.from_str(text)
        found.no_truncation()
        found.no_padding()
        return found

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, points: np.ndarray) -> None:
        """Asks the library which class each character has: it makes one pre-token with two of its own class."""
        for p in points.tolist():
            c = chr(p)
            one = lambda x: len(self.split.pre_tokenize_str(x + c + x)) == 1  # noqa: B023, E731
            self.kinds[p] = LETTER if one("a") else NUMBER if one("1") else OTHER if one("!") else SPACE

    def bounds(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pre-tokens start, for texts one after the other; ``first`` marks where texts do."""
        kind = self.kinds[points]
        if (kind == UNKNOWN).any():
            self._learn(np.unique(points[kind == UNKNOWN]))
            kind = self.kinds[points]
        space, blank = kind == SPACE, points == 32
        run = first.copy()
        run[1:] |= kind[1:] != kind[:-1]
        start = run.copy()
        inner = ~first[1:]
        start[1:] &= ~(blank[:-1] & ~space[1:] & inner)  # a blank joins what follows
        start[:-1] |= space[:-1] & ~space[1:] & inner  # the last space before a word is apart
        for i in np.flatnonzero((points == 39) & run & start).tolist():
            tail = points[i + 1 : i + 3].tolist()
            inside = [not x for x in first[i + 1 : i + 3].tolist()]
            if not tail or not inside[0]:
                continue
            size = 2 if chr(tail[0]) in "stmd" else 3 if len(tail) == 2 and inside[1] and (chr(tail[0]) + chr(tail[1])) in ("re", "ve", "ll") else 0
            if size:
                start[i + 1 : i + size] = False
                if i + size < len(start):
                    start[i + size] = True
        return start

    def _many(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        if not len(points):
            return [np.zeros(0, np.uint32) for _ in texts]
        ends = np.cumsum([len(t) for t in texts])
        first = np.zeros(len(points) + 1, bool)
        first[ends], first[0] = True, True
        at = np.flatnonzero(self.bounds(points, first[:-1]))
        data = joined.encode()
        if len(data) > len(points):
            wide = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), dtype=np.int64)])
            starts, stop = wide[at], wide[-1]
        else:
            starts, stop = at, len(points)
        found = self.pieces.entries(data, starts, np.append(starts[1:], stop))
        if found is None:
            self.pieces.clear()
            found = self.pieces.entries(data, starts, np.append(starts[1:], stop))
            if found is None:
                return self.whole(texts)
        counts = self.pieces.count[found]
        done = np.concatenate([[0], np.cumsum(counts)])
        ids = self.pieces.pool[np.repeat(self.pieces.first[found] - done[:-1], counts) + np.arange(done[-1])]
        cut = done[np.searchsorted(at, np.concatenate([[0], ends]))]
        return [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text."""
        if not self.plain:
            return self.whole(texts)
        out: list = [None] * len(texts)
        odd = [i for i, t in enumerate(texts) if any(x in t for x in self.special)]
        for i, ids in zip(odd, self.whole([texts[i] for i in odd]) if odd else [], strict=True):
            out[i] = ids
        held: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if out[i] is None:
                held.append(i)
                size += len(t)
            if held and (size >= BATCH_CHARS or i == len(texts) - 1):
                for k, ids in zip(held, self._many([texts[k] for k in held]), strict=True):
                    out[k] = ids
                held, size = [], 0
        checked = [i for i, t in enumerate(texts) if t and zlib.crc32(t.encode()) % CHECK_EVERY == 0]
        for i, ids in zip(checked, self.whole([texts[i] for i in checked]) if checked else [], strict=True):
            if not np.array_equal(out[i], ids):
                raise ValueError("a text's ids differ from the library's on the whole text")
        return out
