"""Substring dedup by seed and extend over words.

Documents meet at winnowed anchors (see :mod:`repeats`); from an anchor that two of them share,
their match is extended word by word to the left and to the right, and kept as a repeat if it spans
50 words or more. Matches of neighbouring anchors are joined along their diagonal, so that a repeat is
as long as it is in both documents (``repeats.repeats`` returns it with its place in the earlier one).
A document loses the words of those repeats whose partner is an earlier document.

Defined results: null text has no words; a document of under 50 words loses none, a very long one is
searched whole; repeats inside one document stay; of documents that tie in a passage the least doc_id
keeps it; rows that repeat a doc_id do not count as earlier than each other; a row without doc_id is
kept whole and makes nothing else a repeat; extra columns, whatever their names, are not read and
:func:`strip_repeats` returns them as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, documents, rows_of
from .repeats import Spec, repeated_spans, with_spans

WINDOW = 50
SEED_WORDS = 10

_WORDS = Memo(xxhash.xxh3_64_intdigest)


def word_tokens(text: str) -> np.ndarray:
    words = text.encode().split()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def extend(groups: list[list[tuple]]) -> Iterator[tuple]:
    """Segments that share an anchor, by ascending doc → (g, lo, *MATCH) of matches with an earlier doc."""
    for group in groups:
        if len(group) < 2:
            continue
        docs = np.array([r[1] for r in group])
        if docs[0] == docs[-1]:
            continue
        left, width = WINDOW - SEED_WORDS + 1, 3 * WINDOW
        grid = np.empty((len(group), width), np.uint64)
        grid[:] = np.arange(1, len(group) + 1, dtype=np.uint64)[:, None]  # matches nothing
        for i, (_, _, _, _, offset, content) in enumerate(group):
            words = np.frombuffer(content, np.uint64)
            grid[i, left - offset : left - offset + len(words)] = words
        starts = np.searchsorted(docs, docs)  # of the first row of each doc
        for x in range(1, len(group)):
            if not starts[x]:
                continue
            same = grid[x] == grid[: starts[x]]
            back, ahead = np.argmin(same[:, left - 1 :: -1], axis=1), np.argmin(same[:, left:], axis=1)
            long = np.flatnonzero(back + ahead >= WINDOW)
            g, doc, twin, lo, offset, _ = group[x]
            place, done = lo + offset, set()
            for i in long.tolist():  # of equal stretches the earliest partner's
                b, a = int(back[i]), int(ahead[i])
                if (b, a) not in done:
                    done.add((b, a))
                    yield g, lo, doc, twin, place - b, place + a, group[i][1], group[i][2], group[i][3] + group[i][4] - b


SPEC = Spec(window=WINDOW, k=SEED_WORDS, tokens=word_tokens, units=word_tokens, cut=lambda u, a, b: u[a:b].tobytes(), within=False, most_segments=256, anew=False, kernel=extend)


def kept_words(text: str, starts: Sequence | None, stops: Sequence | None) -> tuple[list[bytes], int]:
    words = text.encode().split()
    if starts is None or len(starts) == 0:
        return words, len(words)
    out, at = [], 0
    for a, b in zip(starts, stops, strict=True):
        out += words[at:a]
        at = b
    return out + words[at:], len(words)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for doc_ids, texts, starts, stops in rows_of(batches, "doc", "text", "starts", "stops"):
        kept = [kept_words(t, a, b) for t, a, b in zip(texts, starts, stops, strict=True)]
        cells = [pa.array(doc_ids, pa.int64()), pa.array([n for _, n in kept], pa.int64()), pa.array([n - len(k) for k, n in kept], pa.int64()), pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for k, _ in kept], pa.string())]
        yield pa.RecordBatch.from_arrays(cells, ["doc_id", "n_words", "n_removed", "kept_sha256"])


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return with_spans(docs, repeated_spans(docs, SPEC)).mapInArrow(_report, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def strip_repeats(docs: DataFrame) -> DataFrame:
    """The documents without their repeats, in the input's columns.

    A document without repeats keeps its text as it is; of any other, the words that stay are joined
    by one space and ``n_chars``, if there is such a column, is counted again. Documents of which no
    word stays go; those that had none are kept.
    """
    found = with_spans(docs, repeated_spans(docs, SPEC), keep_rows=True)

    def cut(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
        return pd.Series([b" ".join(kept_words(t, a, b)[0]).decode() for t, a, b in zip(texts, starts, stops, strict=True)], dtype=object)

    cut = F.pandas_udf(cut, "string").asNondeterministic()  # else the filter below would run it a second time
    # only documents with repeats go to Python
    same = found.where("starts is null").select("row", F.lit(None).cast("string").alias("new"))
    made = same.unionAll(found.where("starts is not null").select("row", cut("text", "starts", "stops").alias("new")).where("new <> ''"))
    out = {"text": F.coalesce("new", "row.text")}  # the row's other columns as they are
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("new").isNotNull(), F.length("new").cast("long")).otherwise(F.col("row.n_chars"))
    return made.select(*[out[c].alias(c) if c in out else F.col(f"row.`{c}`") for c in docs.columns])


OP7_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), m as (
  select rid, doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) as h from (select rid, doc_id, w, unnest(range(1, len(w) - 48)) as p from d where len(w) >= 50)
), f as (select h, min(doc_id) as first from m group by h),
covered as (select distinct rid, p + j as i from m join f using (h), range(0, 50) t(j) where doc_id > first),
words as (select rid, unnest(range(1, len(w) + 1)) as i, unnest(w) as x from d),
kept as (
  select rid, count(*) as n, string_agg(x, ' ' order by i) as t from words anti join covered using (rid, i) group by rid
)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (rid)
"""
