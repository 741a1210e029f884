"""Token counts through a digest cache.

A document's key is the SHA-256 of its normalised content. Keys are joined with the cache, a Parquet
table (digest, version, n_tokens); only distinct misses are encoded, and their counts are appended.
``version`` digests the tokenizer file, the library's version and the way of normalising, so that a
count is never read under another tokenizer.

Where the tokenizer drops white space before it merges (checked on its file and by probes), runs of
ASCII white space become one space, none at the ends, and a text's count is the sum of its words';
for any other tokenizer the content is taken as it is and whole texts are counted.

The query's cache is the folder that the session names in ``spark.tessera.tokenCache``; where it names
none, the query starts with an empty cache.

Defined results: null text counts as empty (0 bytes, 0 tokens); a very long text is counted whole;
repeated rows each get a row (equal contents are encoded once, that of the least doc_id; a tie of one
doc_id has the same count); a null doc_id is kept; extra columns, whatever their names, are not read; an
empty table gives an empty result and leaves the cache as it is.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_GAP, BatchMemo, documents, join_counted, kept, materialize, new_path, rows_of

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048


def tokenizer_json(name_or_path: str) -> str:
    """The tokenizer's text, read once on the driver; a bare name is looked up among the public tokenizers."""
    if "/" not in name_or_path:
        import public_tokenizers

        name_or_path = public_tokenizers.path(name_or_path)
    with open(name_or_path, encoding="utf-8") as f:
        return f.read()


PROBES = ("a b", "a  b", " a\tb\n", "a\r\n b c", "x\x0by \x0cz", "it 's 1 2 , . é 日 本")


def drops_gaps(text: str) -> bool:
    """Whether no token can hold or feel white space: the first split removes it, and the probes' pieces have none."""
    import tokenizers

    pre = json.loads(text).get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    if first.get("type") not in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer") and not (first.get("type") == "Split" and first.get("behavior") == "Removed"):
        return False
    whole = tokenizers.Tokenizer.from_str(text)
    count = lambda x: len(whole.encode(x, add_special_tokens=False).ids)
    return all(count(x) == sum(map(count, x.split())) and not any(c.isspace() for _, (a, b) in whole.pre_tokenizer.pre_tokenize_str(x) for c in x[a:b]) for x in PROBES)


class WordCounter:
    """Token counts of whole texts, memoised by word where :func:`drops_gaps` holds.

    Texts with one of ``special`` in them are counted whole.
    """

    def __init__(self, text: str) -> None:
        import tokenizers

        self.by_word = drops_gaps(text)
        self.whole = tokenizers.Tokenizer.from_str(text)
        self.whole.no_truncation()
        self.whole.no_padding()
        #: Added tokens, and what Python splits at but the tokenizer does not.
        self.special = [*(t.content for t in self.whole.get_added_tokens_decoder().values()), "\x1c", "\x1d", "\x1e", "\x1f"]
        mark = self.whole.encode("|", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.words = BatchMemo(self.counts)

    def count(self, text: str) -> int:
        return len(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def counts(self, words: list[str]) -> list[int]:
        """Encoded as one text with a separator's token after each word; words that have the separator in them are encoded alone."""
        joined, found = [w for w in words if self.mark is not None and "|" not in w], {}
        for at in range(0, len(joined), 4096):
            part = joined[at : at + 4096]
            ids = np.array(self.whole.encode_batch_fast(["".join(f"{w} | " for w in part)], add_special_tokens=False)[0].ids)
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) == len(part):
                found |= zip(part, (np.diff(ends, prepend=-1) - 1).tolist(), strict=True)
        return [found[w] if w in found else self.count(w) for w in words]

    def many(self, texts: list[str]) -> list[int]:
        split = [None if not self.by_word or any(x in t for x in self.special) else t.split() for t in texts]
        self.words.learn(set().union(*(u for u in split if u)))
        return [self.count(t) if u is None else sum(map(self.words.__getitem__, u)) for t, u in zip(texts, split, strict=True)]


def version_of(text: str) -> str:
    import tokenizers

    return hashlib.sha256(f"{tokenizers.__version__}|gaps={drops_gaps(text):d}|".encode() + text.encode()).hexdigest()


def count_tokens(docs: DataFrame, cache_path: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_bytes, digest, n_tokens of each row of ``docs``; appends what the cache lacked."""
    spark, text = docs.sparkSession, tokenizer_json(tokenizer)
    version, shared = version_of(text), docs.sparkSession.sparkContext.broadcast(text)  # a file of a few MB
    content = F.coalesce("text", F.lit(""))
    normal = F.trim(F.regexp_replace(content, WORD_GAP, " ")) if drops_gaps(text) else content
    keyed = docs.select("doc_id", F.octet_length(content).cast("long").alias("n_bytes"), F.unhex(F.sha2(normal, 256)).alias("digest"))
    keyed = materialize(keyed, "token-keys")
    schema = "digest binary, version string, n_tokens long"
    spark.createDataFrame([], schema).write.mode("append").parquet(cache_path)  # so that it exists
    known = spark.read.schema(schema).parquet(cache_path).where(F.col("version") == version)
    firsts = materialize(keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "token-firsts")
    wanted = firsts.join(known, "digest", "left_anti").select(F.col("digest").alias("g_"), F.col("doc_id").alias("d_"))
    texts = docs.select("doc_id", normal.alias("normal")).withColumn("digest", F.unhex(F.sha2("normal", 256)))
    texts = texts.join(wanted, F.expr("doc_id <=> d_ and digest = g_"), "left_semi").select("digest", "normal")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("count", version), lambda: WordCounter(shared.value))
        for digests, normals in rows_of(batches, "digest", "normal"):
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(encoder.many(normals), pa.int64())], ["digest", "n_tokens"])

    counts = texts.mapInArrow(encode, "digest binary, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").option("compression", "zstd").parquet(cache_path)
    spark.catalog.refreshByPath(cache_path)
    known = spark.read.schema(schema).parquet(cache_path).where(F.col("version") == version)
    known = known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # two runs may have appended the same
    return join_counted(keyed, known, "digest", firsts).select("doc_id", "n_bytes", "digest", "n_tokens")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = spark.conf.get("spark.tessera.tokenCache", None) or new_path(spark, "token-cache")
    counts = count_tokens(documents(spark, sf_dir), cache)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
