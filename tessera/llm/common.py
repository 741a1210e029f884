"""Shared plumbing of the corpus operators: shared storage, size-checked broadcasts, memoised encoders.

Everything that is written between two steps goes to the folder that the cluster names in
``spark.checkpoint.dir``: the driver and all executors see it, so a lost executor only costs the
tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

pa.set_memory_pool(pa.system_memory_pool())  # gives memory back between tasks, unlike the default pool
#: Separators of words in every contract: space and \t \n \v \f \r.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
#: A side that is written and has at most so many bytes and rows may be broadcast.
BROADCAST_BYTES = 32 << 20
BROADCAST_ROWS = 2_000_000
#: A side of so few rows of at most MAX_CHUNK bytes may be broadcast.
HOT_KEYS = 1_000
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; one of our own only in a local session (tests), where all tasks see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def own_dir(spark: SparkSession) -> str:
    """What this application writes is below it."""
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(df: DataFrame) -> None:
    """Deletes a frame from :func:`materialize` that nothing will read again: what came of it has been written itself."""
    _delete(df.sparkSession, df._tessera_path)


def clean(spark: SparkSession) -> None:
    """Deletes all that this application wrote to the shared folder. Frames that read it are void afterwards."""
    _delete(spark, own_dir(spark))


def materialize(df: DataFrame, tag: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: cuts lineage, runs ``df`` once."""
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def stored_bytes(df: DataFrame) -> int:
    """Bytes that a frame from :func:`materialize` takes on disk."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._tessera_path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """A broadcast hint only if the written frame is within both limits; beyond them the join shuffles."""
    return F.broadcast(df) if stored_bytes(df) <= BROADCAST_BYTES and df.count() <= BROADCAST_ROWS else df


def join_counted(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, most: int = 100_000) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row a key; ``counts``, a written frame, holds (key, n): how many rows meet a key.

    Keys of over ``most`` rows are few; they are joined apart, by a broadcast if there are at most
    HOT_KEYS of them, so that their rows need not meet in one task. Otherwise it is a plain join.
    """
    hot = counts.where(F.col("n") > most).select(key).distinct()
    few = hot.count()
    if not 0 < few <= HOT_KEYS:
        return rows.join(table, key)
    hot = F.broadcast(hot)
    return rows.join(hot, key, "left_anti").join(table, key).unionByName(rows.join(F.broadcast(table.join(hot, key, "left_semi")), key))


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python ``BATCH_BYTES`` at a time, where the session sets no limit: a worker's memory follows the batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rows_of(batches: Iterable[pa.RecordBatch], *columns: str, step: int = 256) -> Iterator[list]:
    """Slices of Arrow batches as lists of Python values, ``step`` rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield [part.column(part.schema.get_field_index(c)).to_pylist() for c in columns]


class Memo(dict):
    """A memo of ``f`` that starts afresh when it holds ``most`` entries, so its memory is bounded."""

    def __init__(self, f: Callable, most: int = 100_000) -> None:
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.f(key)
        return value


class BatchMemo(dict):
    """A memo of ``f``, which takes a list of keys and gives their values; starts afresh beyond ``most`` entries."""

    def __init__(self, f: Callable, most: int = 400_000) -> None:
        super().__init__()
        self.f, self.most = f, most

    def learn(self, keys: set) -> None:
        """Holds all ``keys`` afterwards."""
        missing = list(keys.difference(self))
        if len(self) + len(missing) > self.most:
            self.clear()
            missing = list(keys)
        if missing:
            self.update(zip(missing, self.f(missing), strict=True))


_KEPT: dict = {}


def kept(key: tuple, make: Callable):
    """One object of a kind in a Python worker, so that its memo serves all of the worker's tasks."""
    if _KEPT.get("key" + key[0], (None,))[0] != key:
        _KEPT["key" + key[0]] = (key, make())
    return _KEPT["key" + key[0]][1]
