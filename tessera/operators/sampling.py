"""Deterministic samples and splits: rows are ranked by a hash of their id and a seed.

A rank needs a total order of the table; exact counts cannot be had otherwise. The order is cut by
hash prefixes, as many as the rows ask for, so a task ranks one prefix's rows. Where only the cut is
wanted (:func:`exact_sample`), only the prefix at the cut is ranked: those before it are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import global_rank, parts_for


def hashed(key: str, seed: str) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def prefixed(df: DataFrame, key: str, seed: str) -> DataFrame:
    """Adds ``hash_`` and ``part_``, a prefix of it: 1 to 4 hexadecimal digits."""
    parts, digits = parts_for(df.count()), 1
    while 16**digits < parts:
        digits += 1
    return df.withColumn("hash_", hashed(key, seed)).withColumn("part_", F.substring("hash_", 1, digits))


def _before(rows: DataFrame) -> DataFrame:
    """(part_, n_, before_, all_): at most 65,536 rows."""
    parts = rows.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    w = Window.orderBy("part_")
    return parts.select("part_", "n_", F.coalesce(F.sum("n_").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"), F.sum("n_").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_"))


def ranked(df: DataFrame, key: str, seed: str) -> DataFrame:
    """Adds ``rank`` (from 1) by hash, then id, in two levels: ranks within hash prefixes plus the counts before them."""
    rows = prefixed(df, key, seed)
    inside = Window.partitionBy("part_").orderBy("hash_", key)
    parts = _before(rows).select("part_", "before_")
    return rows.withColumn("rank", F.row_number().over(inside)).join(F.broadcast(parts), "part_").withColumn("rank", F.col("rank") + F.col("before_")).drop("hash_", "part_", "before_")


def exact_sample(df: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """``round(share * N)`` rows (halves to even); all of them from a share of 1 on."""
    if share >= 1:
        return df
    rows = prefixed(df, key, seed)
    rows = rows.join(F.broadcast(_before(rows)), "part_").withColumn("left_", F.bround(F.col("all_") * share) - F.col("before_"))
    whole = rows.where("left_ >= n_")
    cut = rows.where("left_ > 0 and left_ < n_").withColumn("rank", F.row_number().over(Window.partitionBy("part_").orderBy("hash_", key))).where("rank <= left_").drop("rank")
    return whole.unionByName(cut).select(*df.columns)


def split_712(df: DataFrame, key: str, seed: str) -> DataFrame:
    """Adds ``split``: 7 and 2 tenths, floored, are train and val, the rest is test."""
    n = df.agg(F.count(F.lit(1)).alias("n_"))
    part = F.when(F.col("rank") <= F.floor(F.col("n_") * 7 / 10), "train").when(F.col("rank") <= F.floor(F.col("n_") * 7 / 10) + F.floor(F.col("n_") * 2 / 10), "val").otherwise("test")
    return ranked(df, key, seed).join(F.broadcast(n), F.lit(True)).withColumn("split", part).drop("rank", "n_")


def stratified_split(df: DataFrame, key: str, by: str, share: float, seed: str) -> DataFrame:
    """Adds ``split``: of each class, ``floor(n * share)`` rows are train, the rest val."""
    rows = prefixed(df, key, seed)
    parts = rows.groupBy(by, "part_").agg(F.count(F.lit(1)).alias("n_"))
    w = Window.partitionBy(by)
    parts = parts.select(by, "part_", F.coalesce(F.sum("n_").over(w.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"), F.sum("n_").over(w).alias("all_"))
    rank = F.row_number().over(Window.partitionBy(by, "part_").orderBy("hash_", key)) + F.col("before_")
    return rows.join(parts, [by, "part_"]).withColumn("split", F.when(rank <= F.floor(F.col("all_") * share), "train").otherwise("val")).drop("hash_", "part_", "before_", "all_")


def auto_split(df: DataFrame, key: str, seed: str, weights: tuple[float, float, float] = (0.9, 0.1, 0.0)) -> DataFrame:
    """Adds ``split`` by hash thresholds: no shuffle."""
    u = F.conv(F.substring(hashed(key, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("split", F.when(u < weights[0], "train").when(u < weights[0] + weights[1], "val").otherwise("test"))


def evenly_spaced(df: DataFrame, order: list[str], count: int) -> DataFrame:
    """``count`` rows at ``floor(i * (n - 1) / (count - 1))`` of the order, both ends included."""
    rows = global_rank(df, *order, name="at").withColumn("at", F.col("at") - 1)
    n = df.agg(F.count(F.lit(1)).alias("n_"))
    places = n.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i"), "n_").select(F.floor(F.col("i") * (F.col("n_") - 1) / (count - 1)).alias("at")).distinct()
    return rows.join(F.broadcast(places), "at").drop("at")


def groups_of(df: DataFrame, order: str, size: int = 4) -> DataFrame:
    """Adds ``group``: consecutive rows of the order, ``size`` at a time."""
    return global_rank(df, order, name="group").withColumn("group", F.floor((F.col("group") - 1) / size))


def background_quota(df: DataFrame, key: str, positive: Column, ratio: float, seed: str) -> DataFrame:
    """All positive rows, and of the others ``floor(positives * ratio)`` by hash (all of them for a negative ratio)."""
    if ratio < 0:
        return df
    n = df.agg(F.coalesce(F.sum(positive.cast("long")), F.lit(0)).alias("n_"))
    extra = ranked(df.where(~positive), key, seed).join(F.broadcast(n), F.lit(True)).where(F.col("rank") <= F.floor(F.col("n_") * ratio)).drop("rank", "n_")
    return df.where(positive).unionByName(extra)


def rank_chunks(df: DataFrame, order: str, batch: int, ranks: int) -> DataFrame:
    """Adds ``chunk``: batches in order, dealt out to ``ranks`` workers as contiguous stretches, the first ones longer."""
    rows = global_rank(df, order, name="batch").withColumn("batch", F.floor((F.col("batch") - 1) / batch))
    n = df.agg(F.ceil(F.count(F.lit(1)) / batch).alias("b_"))
    each, more = F.floor(F.col("b_") / ranks), F.col("b_") % ranks
    cut = more * (each + 1)
    chunk = F.when(F.col("batch") < cut, F.floor(F.col("batch") / (each + 1))).otherwise(more + F.floor((F.col("batch") - cut) / F.greatest(each, F.lit(1))))
    return rows.join(F.broadcast(n), F.lit(True)).withColumn("chunk", chunk.cast("long")).drop("b_")


def epoch_mask(df: DataFrame, key: str, share: float, seed: str, epoch: int, epochs: int, close: int = 0) -> DataFrame:
    """Adds ``chosen``: ``round(share * N)`` rows (halves to even) that the seed, the epoch and their number determine.

    Every row keeps its place; one that is not chosen stands for its original. All are chosen from a
    share of 1 on, and none in the last ``close`` epochs.
    """
    if close and epoch >= epochs - close:
        return df.withColumn("chosen", F.lit(False))
    if share >= 1:
        return df.withColumn("chosen", F.lit(True))
    rows = prefixed(df, key, f"{seed}:{epoch}:{epochs}")
    rows = rows.join(F.broadcast(_before(rows).select("part_", "before_", "all_")), "part_")
    rank = F.row_number().over(Window.partitionBy("part_").orderBy("hash_", key)) + F.col("before_")
    return rows.withColumn("chosen", rank <= F.bround(F.col("all_") * share)).select(*df.columns, "chosen")


def grouped_order(pool: DataFrame, image: str, place: str, seed: str, size: int = 4) -> DataFrame:
    """Adds ``unit`` and ``rank``: units of ``size`` images in random order; of a unit's images, in random order too, one sample each in turn.

    So an image's samples lie close together and it need be decoded once. Units are ranked by the
    rows before them, and rows inside their unit.
    """
    images = groups_of(pool.select(image).distinct(), image, size).withColumnRenamed("group", "unit")
    rows = pool.join(images, image)
    hashes = lambda c: F.md5(F.concat(F.col(c).cast("string"), F.lit(f":{seed}")))
    units = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n_")).withColumns({"hash_": hashes("unit")}).withColumn("part_", F.substring("hash_", 1, 3))
    from .scans import running_sums

    units = running_sums(units.withColumn("all_", F.lit(0)), ["all_"], "part_", [F.col("hash_"), F.col("unit")], {"upto_": "n_"}).select("unit", (F.col("upto_") - F.col("n_")).alias("before_"))
    inside = F.row_number().over(Window.partitionBy("unit").orderBy(place, hashes(image), image))
    return rows.withColumn("rank", inside).join(units, "unit").withColumn("rank", F.col("rank") + F.col("before_")).drop("before_").select(*pool.columns, "unit", "rank")


def repeated(df: DataFrame, key: str, epochs: int, seed: str) -> DataFrame:
    """Every row once an epoch, with its ``rank`` in that epoch's own order: what an endless loader yields, for ``epochs`` rounds."""
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}:"), F.col("epoch").cast("string")))
    rows = rows.withColumns({"hash_": digest, "part_": F.substring(digest, 1, 3)})
    parts = rows.groupBy("epoch", "part_").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy("epoch").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("epoch", "part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    rank = F.row_number().over(Window.partitionBy("epoch", "part_").orderBy("hash_", key))
    return rows.withColumn("rank", rank).join(parts, ["epoch", "part_"]).withColumn("rank", F.col("rank") + F.col("before_")).drop("hash_", "part_", "before_")


def ratio_or_count(df: DataFrame, key: str, seed: str, ratio: float = 1.0, count: int = 0) -> DataFrame:
    """``count`` rows if that is above 0, else ``ratio`` of them, rounded, one at least; by hash."""
    n = F.lit(count) if count > 0 else F.greatest(F.lit(1), F.bround(F.col("all_") * ratio))
    rows = prefixed(df, key, seed)
    rows = rows.join(F.broadcast(_before(rows).select("part_", "before_", "all_")), "part_")
    rank = F.row_number().over(Window.partitionBy("part_").orderBy("hash_", key)) + F.col("before_")
    return rows.withColumn("rank_", rank).where(F.col("rank_") <= n).select(*df.columns)


def collate(images: DataFrame, boxes: DataFrame, key: str, size: int) -> DataFrame:
    """The boxes with ``batch`` and ``batch_idx``: images in order, ``size`` to a batch."""
    place = global_rank(images.select(key), key, name="at_")
    place = place.select(key, F.floor((F.col("at_") - 1) / size).alias("batch"), ((F.col("at_") - 1) % size).cast("int").alias("batch_idx"))
    return boxes.join(place, key)


def split_fraction(fraction: float | list, split: str) -> float | int:
    """The share or number of a split's rows to take: a list holds train, val and test (missing ones are whole), a single value is train's.

    0 and 1 mean none and all, as shares; train and val must not be empty.
    """
    taken = dict(zip(("train", "val", "test"), fraction, strict=False)) if isinstance(fraction, list) else {"train": fraction}
    found = taken.get(split, 1.0)
    if found == 0 and split in ("train", "val"):
        raise ValueError(f"no image of {split} would be taken")
    return float(found) if found in (0, 1) else found
