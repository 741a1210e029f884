"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

A source table (one row a source) holds sizes, weights and water-filled targets. Each document's
expected copies are ``target / source_size``; inside a source they are summed in order, one offset
is added, and a document is emitted once for each integer that its running sum crosses.

The running sum has three levels so that no task sees a whole source: documents fall into ordered
buckets of (source, size class, salt) of about SALT_ROWS rows; ranks are taken inside a bucket, the
buckets' counts are summed inside a size class, and the size classes' (a few hundred a source) inside the
source. Salts are hashes of the doc_id (of the text where that is null). Size classes make the order
nearly ascending in size, so a source's words miss its target by about one long document at most.

Defined results: null text counts 0 words, a very long text all of its words; a null source is a source
of its own and sorts last; a null doc_id is a document like any other; ties in size go by doc_id, then by
a hash; repeated rows are separate documents (which of two equal rows gets a copy does not show); extra
columns, whatever their names, are not read and :func:`mix` returns them as they are; an empty table
gives an empty result; if all sizes are 0, every target is 0 and nothing is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, documents, materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2.0
SALT_ROWS = 10_000
SEED = "mix"


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text: each is one character left when its run is squeezed."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "w")
    return F.length(F.regexp_replace(squeezed, "[\\x20\\x09-\\x0D]+", "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """``(source, source_size)`` → weights and targets.

    Water level: sorted by cap/weight, the first k sources are at their caps and the rest share
    what is left by weight; k is the least number for which none of the rest is above its cap. The
    table has one row a source, so its global order is small by nature.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    table = sizes.withColumn("weight", F.element_at(w, (F.pmod(F.row_number().over(by_source) - 1, F.lit(len(weights))) + 1).cast("int")))
    table = table.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    table = table.select(
        "source", "source_size", "weight", "cap",
        ((F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"),
        (F.col("cap") / F.col("weight")).alias("full_at"),
    )
    level = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(whole)
    return table.select("source", "source_size", F.least(F.col("cap"), level * F.col("weight")).alias("target"))


def mix_plan(docs: DataFrame, seed: str = SEED, whole_rows: bool = False) -> DataFrame:
    """One row a document: doc_id, size, source_size, target and copies; with ``whole_rows`` also ``row``, the input row."""
    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("n"), F.coalesce("text", F.lit("")))))
    sized = docs.select(*([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole_rows else []), "doc_id", "source", word_count(F.col("text")).alias("size"), F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long").alias("hash"))
    sized = sized.withColumn("size_class", (F.length(F.bin("size")) * 8 + F.expr("shiftright(size, greatest(length(bin(size)) - 3, 0))")).cast("int"))
    narrow = materialize(sized.drop("row"), "mix-size")
    sized = sized if whole_rows else narrow
    classes = narrow.groupBy("source", "size_class").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("size_class").rowsBetween(Window.unboundedPreceding, -1)  # a few hundred rows a source
    classes = classes.withColumns({"base": F.coalesce(F.sum("n").over(before), F.lit(0)), "salts": F.floor(F.col("n") / SALT_ROWS) + 1})
    classes = materialize(classes.select(F.col("source").alias("s_"), F.col("size_class").alias("c_"), "words", "base", "salts"), "mix-class")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))))
    offset = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    targets = source_targets(classes.groupBy(F.col("s_").alias("source")).agg(F.sum("words").alias("source_size")))
    targets = targets.select(F.col("source").alias("t_"), "source_size", "target", offset.alias("offset"))
    table = materialize(classes.join(targets, F.expr("s_ <=> t_")).select("s_", "c_", "base", "salts", "source_size", "target", "offset"), "mix-target")
    placed = sized.join(broadcast_if_small(table), F.expr("source <=> s_ and size_class = c_")).drop("s_", "c_").withColumn("salt", F.pmod("hash", "salts"))
    key = ["source", "size_class", "salt"]
    ahead = Window.partitionBy("s_", "c_").orderBy("t_").rowsBetween(Window.unboundedPreceding, -1)
    buckets = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    buckets = buckets.select(F.col("source").alias("s_"), F.col("size_class").alias("c_"), F.col("salt").alias("t_"), "n")
    buckets = materialize(buckets.select("s_", "c_", "t_", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead")), "mix-bucket")
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("size", "doc_id", "hash")))
    ranked = ranked.join(broadcast_if_small(buckets), F.expr("source <=> s_ and size_class = c_ and salt = t_"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = lambda rank: F.floor(F.col("offset") + rate * rank)
    rank = F.col("base") + F.col("ahead") + F.col("rank")
    copies = (upto(rank) - upto(rank - 1)).cast("long").alias("copies")
    return ranked.select(*(["row"] if whole_rows else []), "doc_id", "source", "size", "source_size", "target", copies)


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed rows themselves, in the input's columns: each document's row as often as its copies."""
    plan = mix_plan(docs, seed, whole_rows=True).where("copies > 0")
    return plan.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("k")).select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


OP8_SQL = r"""
with sized as (
  select *, length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)) as size_class from (
    select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
      ('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'n' || coalesce(text, ''))), 1, 8))::bigint as hash from documents)
), totals as (
  select source, cast(sum(size) as bigint) as source_size from sized group by source
), weighed as (
  select *, source_size * 2.0::double as cap,
    case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight
  from totals
), levels as (
  select *, cap / weight as full_at,
    (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over w, 0)) / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level
  from weighed window w as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)
), targets as (
  select *, least(cap, (max(level) filter (where level <= full_at) over ()) * weight) as target,
    ('0x' || substr(md5('mix:' || coalesce('s' || source, 'n')), 1, 8))::bigint / 4294967296.0::double as u
  from levels
), ranked as (
  select s.doc_id, s.size, t.source_size, t.target, t.u,
    case when t.source_size > 0 then t.target / t.source_size else 0 end as rate,
    row_number() over (partition by s.source order by size_class, hash % salts, size, doc_id nulls first, hash) as rank
  from (select *, count(*) over (partition by source, size_class) // 10000 + 1 as salts from sized) s join targets t on s.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  cast((floor(u + rate * rank) - floor(u + rate * (rank - 1))) * size as bigint) as taken,
  cast(floor(u + rate * rank) - floor(u + rate * (rank - 1)) as bigint) as copies
from ranked
"""
