"""The canonical tables, derived from the driver's tables (FIXTURES.md §3).

Each is one portable SELECT: Spark runs it over DataFrames, DuckDB over views of the same names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.scans import tasks_for

IMAGE_W, IMAGE_H, CLASSES = 1200.0, 900.0, 6
EDGE = "cast(({pk} * {m}) % 21 - 10 as double) * cast({pk} % 4 as double) * {size} / 36e1"

IMAGES = """
select o_orderkey as image_id, 12e2 as w, 9e2 as h, o_orderpriority as tag,
  concat('images/', cast(o_orderkey as varchar(20)), '.jpg') as im_file from {orders}
"""
_NUMBERED = """
select l_orderkey, l_partkey as pk, l_suppkey as sk, l_quantity as qty, cast(row_number() over (partition by l_orderkey
  order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) as int) as gt_id
from {lineitem}
"""
GT = f"""
select l_orderkey as image_id, gt_id, cast(pk % 6 as int) as cls,
  cast((pk * 37 + gt_id * 101) % 800 as double) as x1, cast((sk * 53 + gt_id * 67) % 600 as double) as y1,
  cast((pk * 37 + gt_id * 101) % 800 as double) + 20 + 4 * qty as x2,
  cast((sk * 53 + gt_id * 67) % 600 as double) + 20 + 4 * cast((pk * 13) % 40 as double) as y2, pk, sk
from ({_NUMBERED}) n
"""
_SHIFT = "{c} + case when dup = 1 then {moved} else {jitter} end as {c}"
_X = [_SHIFT.format(c=c, moved="1e-1 * (x2 - x1)", jitter=EDGE.format(pk="pk", m=m, size="(x2 - x1)")) for c, m in (("x1", 7), ("x2", 3))]
_Y = [_SHIFT.format(c=c, moved="0e0", jitter=EDGE.format(pk="pk", m=m, size="(y2 - y1)")) for c, m in (("y1", 5), ("y2", 11))]
#: One pass over the labels: each gives a prediction, a shifted duplicate, both or neither.
PRED = f"""
select image_id, cast(gt_id + 100 * dup as int) as det_id, cast(case when dup = 0 and pk % 11 = 0 then (cls + 1) % 6 else cls end as int) as cls,
  {_X[0]}, {_Y[0]}, {_X[1]}, {_Y[1]},
  5e-2 + 9e-1 * cast(case when dup = 0 then pk * 7919 + gt_id * 104729 else pk * 104729 + gt_id * 7919 end % 1000 as double) / 1e3 as conf
from ({GT}) g cross join (select 0 as dup union all select 1 as dup) k
where (dup = 0 and (pk + gt_id) % 9 <> 0) or (dup = 1 and pk % 5 = 0)
"""
POINTS = """
select user_id as track_id, cast(row_number() over (partition by user_id order by ts, event_id) as int) as frame, ts, event_type as cls, value,
  cast((event_id * 7919 + user_id * 31) % 640 as double) as x, cast((event_id * 104729) % 480 as double) as y from {events}
"""
TABLES = {"images": IMAGES, "gt": GT, "pred": PRED, "points": POINTS}
SOURCES = ("orders", "lineitem", "events", "embeddings", "labels", "documents", "part")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False) -> DataFrame:
    """``dealt``: labels are dealt out by image before they are numbered, into as many tasks as they ask for.

    All that is by image then keeps to that one exchange and sorts without spilling. Not for what needs
    no numbers, as that needs no exchange either.
    """
    sql = TABLES[name]
    rows = {t: read(spark, sf_dir, t) for t in SOURCES if "{" + t + "}" in sql}
    if dealt and "lineitem" in rows and (tasks := tasks_for(spark, rows["lineitem"].count())):
        rows["lineitem"] = rows["lineitem"].repartition(tasks, "l_orderkey")
    return spark.sql(sql, **rows)


def ctes(*names: str) -> str:
    """``with`` clause of the named tables for DuckDB."""
    out = []
    for n in names:
        sql = TABLES[n]
        for t in SOURCES:
            sql = sql.replace("{" + t + "}", t)
        out.append(f"{n} as ({sql})")
    return "with " + ", ".join(out)
