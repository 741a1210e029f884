"""The corpus pipeline: each stage's rows are written as Parquet and reread as the next one's documents.

Quality rules drop what they reject; near-duplicate groups keep their least doc_id; passages of 50
words or more that an earlier document has are cut; sources are mixed to their target weights, which
drops some rows and repeats others; what is left is encoded. A document that the mix repeats comes
out once for each copy.

Near duplicates are judged on shingles of five words. What nulls, empty and very long texts, ties and
repeated rows give in a stage is what its operator's docstring says; each stage but the last returns the
columns that it got, whatever others than those of ``documents`` are there and whatever their names; an
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, near_dups, quality_rules, spm_codec, substring_dedup
from tessera.llm.common import documents, materialize, small_batches
from tessera.session import ship


NEAR_WORDS = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.keep_first(docs, NEAR_WORDS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.strip_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spm_codec.digests(docs)


STAGES = [("quality rules", quality), ("near duplicates", near), ("repeated passages", passages), ("source mix", mix), ("sentencepiece", encode)]
#: Near duplicates and repeated passages over whole tables are beyond SQL; tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
