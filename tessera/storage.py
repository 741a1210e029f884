"""Results that a query reads more than once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shared(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once: a reliable checkpoint where the cluster names a shared folder, else Spark's cache (spilling to disk)."""
    return df.checkpoint() if _shared(df.sparkSession) else df.persist()


def written(df: DataFrame) -> DataFrame:
    """As :func:`settled`, for many rows: Parquet in the shared folder takes a few bytes a number and runs ``df`` once, where a checkpoint takes eight and runs its last stage twice."""
    spark, shared = df.sparkSession, _shared(df.sparkSession)
    if not shared:
        return df.persist()
    path = f"{shared}/tessera/{spark.sparkContext.applicationId}/rows-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is run here deletes its shuffle files when it ends, and does not wait for the driver's collector to find them unused."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
