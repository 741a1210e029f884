"""Grids, decodes and small rules over the canonical tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import generate as ge
from tessera.operators import suppress
from tessera.operators.evaluation import rounded

from .canonical import ctes, read, table


def point_grid(s, d):
    return rounded(ge.point_grid(s, 32), "x", "y", places=8)


def crop_layers(s, d):
    return ge.crop_layers(table(s, d, "images"), 2)


def tile_decode(s, d):
    return ge.decode_tiles(table(s, d, "images").withColumn("n", F.col("image_id") % 4 + 1), "n")


def latest_event(s, d):
    return ge.latest(read(s, d, "events").withColumn("name", F.lpad(F.col("event_id").cast("string"), 12, "0")), "user_id", "name", "ts")


def track_velocity(s, d):
    return rounded(ge.velocity(table(s, d, "points")).select("track_id", "frame", "dx", "dy"), "dx", "dy", places=5)


def negative_texts(s, d):
    words = read(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("name"))
    return ge.negative_texts(words, 3, 5, "neg")


def ratio_padding(s, d):
    return rounded(ge.ratio_pad(table(s, d, "gt"), table(s, d, "images"), 16 / 9), "cx", "cy", "w", "h")


def new_track_candidates(s, d):
    pred = table(s, d, "pred")
    fresh = ge.allowed_new(pred.where("det_id >= 100"), pred.where("det_id < 100 and conf > 0.8"), 0.3, 0.55)
    return suppress.fast_nms(fresh, 0.55).select("image_id", "det_id")


def merged_lists(s, d):
    """Image lists one after the other, repeats kept."""
    im = table(s, d, "images").select("im_file")
    return im.where("im_file like '%1.jpg'").unionAll(im.where("im_file like '%11.jpg'")).groupBy("im_file").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (point_grid, crop_layers, tile_decode, latest_event, track_velocity, negative_texts, ratio_padding, new_track_candidates, merged_lists)}

_I = ctes("images")
_IOU = "greatest(0, least(p.x2, q.x2) - greatest(p.x1, q.x1)) * greatest(0, least(p.y2, q.y2) - greatest(p.y1, q.y1)) / ((p.x2 - p.x1) * (p.y2 - p.y1) + (q.x2 - q.x1) * (q.y2 - q.y1) - greatest(0, least(p.x2, q.x2) - greatest(p.x1, q.x1)) * greatest(0, least(p.y2, q.y2) - greatest(p.y1, q.y1)) + {eps})"
SQL = {
    "point_grid": "select i, round((i % 32 + 0.5) / 32, 8) as x, round((i // 32 + 0.5) / 32, 8) as y from range(0, 1024) t(i)",
    "crop_layers": f"""{_I}, l as (select image_id, w, h, layer, pow(2, layer) as s, floor(512 / 1500.0::double * least(w, h) * (2 / pow(2, layer))) as gap from images, (values (1), (2)) v(layer)),
      c as (select *, ceil((gap * (s - 1) + w) / s) as cw, ceil((gap * (s - 1) + h) / s) as ch from l), g as (select *, unnest(range(0, cast(s as bigint))) as i from c), k as (select *, unnest(range(0, cast(s as bigint))) as j from g)
      select image_id, 0 as layer, 0::bigint as x0, 0::bigint as y0, cast(w as bigint) as x1, cast(h as bigint) as y1 from images
      union all select image_id, layer, cast((cw - gap) * i as bigint), cast((ch - gap) * j as bigint), cast(least((cw - gap) * i + cw, w) as bigint), cast(least((ch - gap) * j + ch, h) as bigint) from k""",
    "tile_decode": f"{_I}, t as (select image_id, unnest(range(0, image_id % 4 + 1)) as k from images) select row_number() over (order by image_id, k) - 1 as idx, image_id, cast(k as int) as k from t",
    "latest_event": "select user_id, lpad(cast(event_id as varchar), 12, '0') as name from (select *, row_number() over (partition by user_id order by ts desc, lpad(cast(event_id as varchar), 12, '0')) as n from events) where n = 1",
    "track_velocity": f"{ctes('points')}, o as (select *, first_value(x) over w as ox, first_value(y) over w as oy from points window w as (partition by track_id order by frame rows between 3 preceding and current row)), v as (select *, sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy)) + 1e-6::double as n from o) select track_id, frame, round((x - ox) / n, 5) as dx, round((y - oy) / n, 5) as dy from v",
    "negative_texts": "with w as (select unnest(string_split(p_name, ' ')) as name from part), o as (select name, count(*) as n from w group by name having count(*) >= 3) select name, n from (select *, row_number() over (order by md5(name || ':neg'), name) as r from o) where r <= 5",
    "ratio_padding": f"""{ctes("images", "gt")}, s as (select image_id, greatest(w, h * {16 / 9!r}::double) as pw, greatest(h, w / {16 / 9!r}::double) as ph, w, h from images)
      select image_id, gt_id, cls, round(least(1, greatest(0, ((x1 + x2) / 2 + (pw - w) / 2) / pw)), 6) as cx, round(least(1, greatest(0, ((y1 + y2) / 2 + (ph - h) / 2) / ph)), 6) as cy, round(least(1, greatest(0, (x2 - x1) / pw)), 6) as w, round(least(1, greatest(0, (y2 - y1) / ph)), 6) as h from gt join s using (image_id)""",
    "new_track_candidates": f"""{ctes("pred")}, f as (select * from pred p where det_id >= 100 and conf > 0.3 and not exists (select 1 from pred q where q.image_id = p.image_id and q.det_id < 100 and q.conf > 0.8 and {_IOU.format(eps="1e-7::double")} > 0.55))
      select image_id, det_id from f p where not exists (select 1 from f q where q.image_id = p.image_id and q.cls = p.cls and (q.conf > p.conf or (q.conf = p.conf and q.det_id < p.det_id)) and {_IOU.format(eps="0")} >= 0.55)""",
    "merged_lists": f"{_I}, u as (select im_file from images where im_file like '%1.jpg' union all select im_file from images where im_file like '%11.jpg') select im_file, count(*) as n from u group by im_file",
}
