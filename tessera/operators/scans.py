"""Running sums over orders that may be long: two levels, so that no task sees a whole group.

A bucket column cuts each group's order into consecutive parts. The parts' totals are few; they are
summed over the group, and each row adds what came before its part to its place within the part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows that a part of an order holds on average.
PART_ROWS = 50_000
MOST_PARTS = 1 << 16


def parts_for(rows: int) -> int:
    """In how many parts to cut an order of so many rows."""
    return min(MOST_PARTS, max(16, rows // PART_ROWS))


#: Rows that a task sorts in memory, whatever the session's number of partitions.
TASK_ROWS = 200_000


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """Into how many tasks to deal out so many rows, where the session's partitions would hold too many to sort them without spilling."""
    return n if (n := rows // TASK_ROWS) > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def running_sums(df: DataFrame, keys: list[str], bucket: str, order: list[Column], sums: dict[str, str | Column], tasks: int | None = None) -> DataFrame:
    """Adds ``{new: column to sum}`` as inclusive running sums in (bucket, order) within ``keys``. Columns made of others are made after the exchange, which has ``tasks`` parts or the session's number."""
    parts = df.groupBy(*keys, bucket).agg(*[F.sum(c).alias(f"part_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, bucket, *[F.coalesce(F.sum(f"part_{n}").over(before), F.lit(0)).alias(f"base_{n}") for n in sums])
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = {f"sum_{n}": c for n, c in sums.items() if isinstance(c, Column)}
    here = df.repartition(*([tasks] if tasks else []), *keys, bucket).withColumns(made)
    here = here.withColumns({f"here_{n}": F.sum(f"sum_{n}" if f"sum_{n}" in made else c).over(inside) for n, c in sums.items()}).drop(*made)
    out = here.join(parts, [*keys, bucket])
    return out.withColumns({n: F.col(f"base_{n}") + F.col(f"here_{n}") for n in sums}).drop(*[f"{p}_{n}" for n in sums for p in ("here", "base")])


def global_rank(df: DataFrame, first: str, *rest: str, name: str = "rank", parts: int | None = None) -> DataFrame:
    """Adds ``name``: place from 1 in the order of ``first`` (a number) and ``rest`` over the whole table.

    Quantiles of ``first`` cut the order into ``parts`` (by default as many as the rows ask for):
    first coarse ones, then fine ones within each, so that a row looks through two short lists. Ranks
    are taken within a part and moved by the counts of the parts before it. How even the parts are
    affects speed only.
    """
    parts = parts or parts_for(df.count())
    coarse = max(2, round(parts**0.5))
    shares = F.array(*[F.lit(i / coarse) for i in range(1, coarse)])
    value = F.col(first)
    under = lambda cuts: F.size(F.filter(cuts, lambda c: c < value))
    cuts = df.agg(F.percentile_approx(first, shares, F.lit(10 * coarse)).alias("cuts_"))  # one row
    placed = df.join(F.broadcast(cuts), F.lit(True)).withColumn("outer_", F.when(value.isNull(), -1).otherwise(under("cuts_"))).drop("cuts_")
    fine = placed.groupBy("outer_").agg(F.percentile_approx(first, shares, F.lit(10 * coarse)).alias("fine_"))  # ``coarse`` rows of as many numbers
    placed = placed.join(F.broadcast(fine), "outer_").withColumn("inner_", F.when(value.isNull(), -1).otherwise(under("fine_"))).drop("fine_")
    key = ["outer_", "inner_"]
    counts = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n_"))  # about ``parts`` rows, MOST_PARTS and a few at most
    before = F.sum("n_").over(Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*key, F.coalesce(before, F.lit(0)).alias("before_"))
    inside = F.row_number().over(Window.partitionBy(*key).orderBy(first, *rest))
    return placed.withColumn(name, inside).join(F.broadcast(counts), key).withColumn(name, F.col(name) + F.col("before_")).drop(*key, "before_")
