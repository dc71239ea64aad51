"""Queries over boxes, gates and pairs of boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.boxes import Box
from ..operators import gates, spans
from . import views
from .registry import query, r6, rounded

ID = ["cam", "frame_idx", "slot"]
D, P = views.DETECTIONS, views.PAIRS


def other() -> Box:
    return Box(*(F.col(f"o{n}") for n in Box._fields))


def clip_sql(x1: str, y1: str, x2: str, y2: str, w: str, h: str) -> str:
    return f"least(greatest({x1}, 0), {w}) as x1, least(greatest({y1}, 0), {h}) as y1, least(greatest({x2}, 0), {w}) as x2, least(greatest({y2}, 0), {h}) as y2"


@query(f"""select cam, frame_idx, slot, round(greatest(x2-x1,0), 6) as width, round(greatest(y2-y1,0), 6) as height, round(greatest(x2-x1,0)*greatest(y2-y1,0), 6) as area, round((x1+x2)/2, 6) as cx, round((y1+y2)/2, 6) as cy from {D}""")
def b1_box_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, (cx, cy) = Box.of(), boxes.center(Box.of())
    return views.detections(spark, sf_dir).select(*ID, r6(boxes.width(b)).alias("width"), r6(boxes.height(b)).alias("height"), r6(boxes.area(b)).alias("area"), r6(cx).alias("cx"), r6(cy).alias("cy"))


@query(f"select cam, frame_idx, slot, round(x1*0.5::double, 6) as x1, round(y1*1.5::double, 6) as y1, round(x2*0.5::double, 6) as x2, round(y2*1.5::double, 6) as y2 from {D}")
def b2_scale_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.detections(spark, sf_dir).select(*ID, *rounded(boxes.scaled(Box.of(), 0.5, 1.5)))


@query(f"select cam, frame_idx, slot, floor(x1/3)::bigint as x1, floor(y1/3)::bigint as y1, ceil(x2/3)::bigint as x2, ceil(y2/3)::bigint as y2 from {D}")
def b3_integer_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes.integer_bounds(Box(*(c / 3 for c in Box.of())))
    return views.detections(spark, sf_dir).select(*ID, *(c.alias(n) for n, c in zip(Box._fields, b, strict=True)))


@query(f"select cam, frame_idx, slot, {clip_sql('x1-300', 'y1-250', 'x2-300', 'y2-250', '400', '60')} from {D}")
def b4_clip_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Box.of()
    moved = Box(b.x2 - 300, b.y2 - 250, b.x1 - 300, b.y1 - 250)  # inverted corners
    return views.detections(spark, sf_dir).select(*ID, *rounded(boxes.clipped(moved, 400, 60)))


@query(f"select cam, frame_idx, least(x1, ox1) as x1, least(y1, oy1) as y1, greatest(x2, ox2) as x2, greatest(y2, oy2) as y2 from {P}")
def b5_union_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pairs(spark, sf_dir).select("cam", "frame_idx", *rounded(boxes.union(Box.of(), other())))


IOU = "case when s > 0 then s / (greatest(x2-x1,0)*greatest(y2-y1,0) + greatest(ox2-ox1,0)*greatest(oy2-oy1,0) - s) else 0 end"
SHARED = "greatest(least(x2,ox2)-greatest(x1,ox1),0)*greatest(least(y2,oy2)-greatest(y1,oy1),0) as s"


@query(f"select cam, frame_idx, round({IOU}, 6) as iou from (select *, {SHARED} from {P})")
def b6_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pairs(spark, sf_dir).select("cam", "frame_idx", r6(boxes.iou(Box.of(), other())).alias("iou"))


@query(f"select cam, frame_idx, slot, round(x1, 6) as x1, round(y1, 6) as y1, round(x2, 6) as x2, round(y2, 6) as y2 from (select cam, frame_idx, slot, {clip_sql('x1-(x2-x1)*0.35::double', 'y1-(y2-y1)*0.35::double', 'x2+(x2-x1)*0.35::double', 'y2+(y2-y1)*0.35::double', '700', '300')} from {D})")
def b7_expand_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.detections(spark, sf_dir).select(*ID, *rounded(boxes.expanded(Box.of(), 0.35, 700, 300)))


@query(f"select cam, frame_idx, slot, round(x1, 6) as x1, round(y1, 6) as y1, round(x2, 6) as x2, round(y2, 6) as y2 from (select cam, frame_idx, slot, {clip_sql('x1*(1920::double/1280)', 'y1*(1080::double/720)', 'x2*(1920::double/1280)', 'y2*(1080::double/720)', '1920', '1080')} from {D})")
def b8_map_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.detections(spark, sf_dir).select(*ID, *rounded(boxes.mapped(Box.of(), (1280, 720), (1920, 1080))))


CROP = f"""(select *, least(greatest(floor(a1),0),700)::bigint as c1, least(greatest(floor(b1),0),300)::bigint as d1, least(greatest(ceil(a2),0),700)::bigint as c2, least(greatest(ceil(b2),0),300)::bigint as d2 from
  (select cam, frame_idx, slot, least(greatest(x1-(x2-x1)*0.1::double,0),700) as a1, least(greatest(y1-(y2-y1)*0.1::double,0),300) as b1, least(greatest(x2+(x2-x1)*0.1::double,0),700) as a2, least(greatest(y2+(y2-y1)*0.1::double,0),300) as b2 from {D}))"""


@query(f"select cam, frame_idx, slot, c1 as x1, d1 as y1, c2 as x2, d2 as y2, c2 <= c1 or d2 <= d1 as is_empty from {CROP}")
def b9_crop_rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.detections(spark, sf_dir).select(*ID, boxes.crop_rectangle(Box.of(), 0.1, 700, 300).alias("r")).select(*ID, "r.*")


POLYGON = ((100.0, 150.0), (500.0, 200.0), (900.0, 120.0), (700.0, 330.0), (400.0, 260.0))
EDGES = "(values " + ", ".join(f"({POLYGON[i - 1][0]}::double, {POLYGON[i - 1][1]}::double, {x}::double, {y}::double)" for i, (x, y) in enumerate(POLYGON)) + ") e(ax, ay, cx, cy)"
IN_POLYGON = f"""(select cam, frame_idx, slot, bool_or(abs((y-ay)*(cx-ax) - (x-ax)*(cy-ay)) <= 1e-9 and (x-ax)*(x-cx) + (y-ay)*(y-cy) <= 1e-9)
  or count(case when (cy > y) <> (ay > y) and x < (ax-cx)*(y-cy)/nullif(ay-cy,0) + cx then 1 end) % 2 = 1 as inside
  from (select *, (x1+x2)/2 as x, (y1+y2)/2 as y from {D}), {EDGES} group by 1, 2, 3)"""


def polygon(points=POLYGON, w: float = 1.0, h: float = 1.0):
    return F.array(*(F.struct(F.lit(x / w).alias("x"), F.lit(y / h).alias("y")) for x, y in points))


@query(f"select * from {IN_POLYGON}")
def b10_point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = boxes.center(Box.of())
    return views.detections(spark, sf_dir).select(*ID, boxes.in_polygon(x, y, polygon()).alias("inside"))


@query(f"""select cam, frame_idx, slot, least(greatest(ceil(x2),0),850) - least(greatest(floor(x1),0),850) >= 32 and least(greatest(ceil(y2),0),720) - least(greatest(floor(y1),0),720) >= 32 as usable from {D}""")
def b11_usable_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.detections(spark, sf_dir).select(*ID, boxes.usable(Box.of(), 850, 720, 32).alias("usable"))


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds and zones of each camera; every other one has zones."""
    zone = F.array(polygon(w=views.WIDTH, h=views.HEIGHT))
    none = F.slice(zone, 1, 0)
    hole = F.array(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.3, 0.2), (0.5, 0.2), (0.5, 0.4), (0.3, 0.4)))))
    cams = views.detections(spark, sf_dir).select("cam").distinct()
    return cams.select("cam", (F.lit(30.0) / 100 + F.col("cam") % 5 * F.lit(5.0) / 100).alias("detection_conf_threshold"), F.when(F.col("cam") % 2 == 0, zone).otherwise(none).alias("roi"), hole.alias("ignore_zones"))


@query(f"""select cam, (30::double/100 + cam % 5 * 5::double/100) as detection_conf_threshold, case when cam % 2 = 0 then 1 else 0 end as n_roi, true as valid from (select distinct cam from {D})""")
def a9_camera_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.settings import checked_cameras

    rows = checked_cameras(cameras(spark, sf_dir))
    return rows.select("cam", "detection_conf_threshold", F.size("roi").alias("n_roi"), F.col("problem").isNull().alias("valid"))


GATE_EDGES = "(values " + ", ".join(f"({POLYGON[i - 1][0]}::double/1280, {POLYGON[i - 1][1]}::double/720, {x}::double/1280, {y}::double/720)" for i, (x, y) in enumerate(POLYGON)) + ") e(ax, ay, cx, cy)"


@query(f"""with d as (select *, (x1+x2)/2/1280 as x, (y1+y2)/2/720 as y from {D}),
i as (select cam, frame_idx, slot, bool_or(abs((y-ay)*(cx-ax) - (x-ax)*(cy-ay)) <= 1e-9 and (x-ax)*(x-cx) + (y-ay)*(y-cy) <= 1e-9)
  or count(case when (cy > y) <> (ay > y) and x < (ax-cx)*(y-cy)/nullif(ay-cy,0) + cx then 1 end) % 2 = 1 as inside from d, {GATE_EDGES} group by 1, 2, 3)
select d.cam, d.frame_idx, d.slot, round(confidence, 6) as confidence from d join i using (cam, frame_idx, slot)
where confidence >= 30::double/100 + cam % 5 * 5::double/100 and (cam % 2 = 1 or inside) and not (x between 0.3 and 0.5 and y between 0.2 and 0.4)""")
def e1_detection_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.detections(spark, sf_dir).withColumns({"width": F.lit(views.WIDTH), "height": F.lit(views.HEIGHT)})
    return gates.gate(rows, cameras(spark, sf_dir), "cam").select(*ID, r6("confidence").alias("confidence"))


@query(f"select cam, frame_idx, slot, row_number() over (partition by cam, frame_idx order by confidence desc, slot) - 1 as det_rank, x1, least(y2, 262) as y2 from {D} where class_name = 'dog' and confidence >= 0.5::double")
def e2_accepted_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.accepted(views.detections(spark, sf_dir), ["cam", "frame_idx"], [], 0.5, F.lit(1280), F.lit(262)).select(*ID, "det_rank", "x1", "y2")


@query(f"select t, count(case when confidence >= t then 1 end) as kept, count(case when confidence < t then 1 end) as dropped from {D}, (values (0.3::double), (0.5::double), (0.8::double)) v(t) group by t")
def e3_threshold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.createDataFrame([(0.3,), (0.5,), (0.8,)], "t double")
    rows = gates.split_by_threshold(views.detections(spark, sf_dir).join(F.broadcast(grid), F.lit(True)), F.col("t"))
    return rows.groupBy("t").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


BOOST = "confidence + case when class_name = 'dog' then 5::double/100 else 0 end"


@query(f"""with d as (select * replace (x1 - case when slot = 2 then 600 else 0 end as x1, x2 - case when slot = 2 then 600 else 0 end as x2), {BOOST} as p from {D}),
o as (select d.*, e.x1 as ox1, e.y1 as oy1, e.x2 as ox2, e.y2 as oy2, e.p as op from d left join d e on d.cam = e.cam and d.frame_idx = e.frame_idx and d.slot <> e.slot)
select cam, frame_idx, slot, class_name, round(confidence, 6) as confidence from (select *, {SHARED} from o) where op is null or p > op or (p = op and slot = 1) or {IOU} <= 0.3::double""")
def f1_duplicate_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.detections(spark, sf_dir)
    over = F.when(F.col("slot") == 2, 600).otherwise(0)
    moved = rows.withColumns({"x1": F.col("x1") - over, "x2": F.col("x2") - over})
    return gates.suppressed(moved, ["cam", "frame_idx"], 0.3).select(*ID, "class_name", r6("confidence").alias("confidence"))


@query(f"""select cam, frame_idx, n as n_tracks, n > 1 as multi, n > 1 or coalesce(iou >= 0.2::double, false) as ambiguous from
(select cam, frame_idx, count(distinct slot) as n from {D} group by 1, 2) left join (select cam, frame_idx, {IOU} as iou from (select *, {SHARED} from {P})) using (cam, frame_idx)""")
def f6_ambiguous_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.detections(spark, sf_dir)
    over = F.when(F.col("slot") == 2, 600).otherwise(0)
    return gates.ambiguous_frames(rows.withColumns({"x1": F.col("x1") - over, "x2": F.col("x2") - over}), ["cam", "frame_idx"], "slot")


@query(f"""with b as (select cam, cast(floor(frame_idx / 60) as int) as blk, slot, frame_idx from {D})
select cam, blk, count(distinct slot) > 1 as multi, count(distinct slot) as n_tracks from b group by 1, 2""")
def g11_multi_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.detections(spark, sf_dir).withColumn("blk", F.floor(F.col("frame_idx") / views.BLOCK).cast("int"))
    return rows.groupBy("cam", "blk").agg((F.count_distinct("slot") > 1).alias("multi"), F.count_distinct("slot").alias("n_tracks"))


@query(f"select cam, frame_idx, slot from (select *, row_number() over (partition by cam, frame_idx order by confidence desc, (x2-x1)*(y2-y1) desc, det_rank) as r from {D}) where r = 1")
def h11_best_box_per_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.best_per_frame(views.detections(spark, sf_dir), ["cam", "frame_idx"]).select(*ID)


@query(f"select cam, frame_idx, slot, r as rank from (select *, row_number() over (partition by cam, frame_idx order by confidence desc, det_rank) as r from {D} where confidence >= 0.35::double) where r <= 1")
def i3_top_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.top_objects(views.detections(spark, sf_dir), ["cam", "frame_idx"], 0.35, 1).select(*ID, "rank")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.detections(spark, sf_dir).withColumn("track_id", F.col("slot").cast("string"))


H1 = f"""(select *, list({{'t': mono_ts, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} order by mono_ts) over (partition by cam, slot order by mono_ts range between 1.0::double preceding and current row) as recent from {D})"""


@query(f"""with h as {H1}, s as (select cam, frame_idx, slot, recent[1].t as window_start, recent[-1].t - recent[1].t as span_s, len(recent) as n_recent,
  list_max(list_transform(recent, lambda r: sqrt(((r.x1+r.x2)/2-(recent[1].x1+recent[1].x2)/2)**2 + ((r.y1+r.y2)/2-(recent[1].y1+recent[1].y2)/2)**2))) as motion_px,
  greatest(10, 0.2::double * list_sort(list_transform(recent, lambda r: sqrt((r.x2-r.x1)**2 + (r.y2-r.y1)**2)))[len(recent) // 2 + 1]) as allowed_px from h)
select cam, frame_idx, slot, window_start, round(span_s, 6) as span_s, n_recent, round(motion_px, 6) as motion_px, round(allowed_px, 6) as allowed_px,
  span_s >= 1.0 - 0.4::double and n_recent >= 2 and motion_px <= allowed_px as stationary from s""")
def h1_stationarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans.stationarity(tracks(spark, sf_dir), ["cam", "slot"], 1.0, 5.0)
    return rows.select(*ID, "window_start", r6("span_s").alias("span_s"), "n_recent", r6("motion_px").alias("motion_px"), r6("allowed_px").alias("allowed_px"), "stationary")


@query(f"""with h as {H1}, n as (select *, list_filter(recent, lambda r: sqrt(((r.x1+r.x2)/2-(x1+x2)/2)**2 + ((r.y1+r.y2)/2-(y1+y2)/2)**2) <= sqrt((x2-x1)**2 + (y2-y1)**2)) as near from h),
u as (select *, list_min(list_transform(near, lambda r: r.x1)) as a, list_min(list_transform(near, lambda r: r.y1)) as b, list_max(list_transform(near, lambda r: r.x2)) as c, list_max(list_transform(near, lambda r: r.y2)) as d from n)
select cam, frame_idx, slot, case when raw then x1 else a end as x1, case when raw then y1 else b end as y1, case when raw then x2 else c end as x2, case when raw then y2 else d end as y2 from (select *, (c-a)*(d-b) > 4*(x2-x1)*(y2-y1) as raw from u)""")
def h2_trailing_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans.steadied(tracks(spark, sf_dir), ["cam", "slot"], 1.0)
    return rows.select(*ID, *(F.col(f"u{n}").alias(n) for n in Box._fields))


STILL = f"""(with h as {H1}, s as (select *, recent[1].t as window_start, recent[-1].t - recent[1].t as span_s, len(recent) as n_recent,
  list_max(list_transform(recent, lambda r: sqrt(((r.x1+r.x2)/2-(recent[1].x1+recent[1].x2)/2)**2 + ((r.y1+r.y2)/2-(recent[1].y1+recent[1].y2)/2)**2))) as motion_px,
  greatest(10, 0.2::double * list_sort(list_transform(recent, lambda r: sqrt((r.x2-r.x1)**2 + (r.y2-r.y1)**2)))[len(recent) // 2 + 1]) as allowed_px from h)
select cam, frame_idx, slot, mono_ts, window_start, span_s, motion_px, span_s >= 1.0 - 0.4::double and n_recent >= 2 and motion_px <= allowed_px as stationary from s)"""
RUNS = f"""(with b as (select *, case when stationary and not coalesce(lag(stationary) over (partition by cam, slot order by mono_ts), false) then 1 else 0 end as begins from {STILL}),
r as (select *, sum(begins) over (partition by cam, slot order by mono_ts rows unbounded preceding) as run from b)
select *, mono_ts - first_value(window_start) over (partition by cam, slot, run order by mono_ts) as dwell_s from r where stationary)"""


@query(f"select cam, slot, run::bigint as run, round(max(dwell_s), 6) as dwell_s, count(*) as n from {RUNS} group by 1, 2, 3")
def h9_dwell_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    still = spans.stationarity(tracks(spark, sf_dir), ["cam", "slot"], 1.0, 5.0)
    runs = spans.dwell_runs(still, ["cam", "slot"])
    return runs.groupBy("cam", "slot", "run").agg(r6(F.max("dwell_s")).alias("dwell_s"), F.count("*").alias("n"))


@query(f"select cam, frame_idx, slot, round(dwell_s, 6) as dwell_s from (select *, row_number() over (partition by cam, frame_idx order by dwell_s desc, span_s desc, motion_px, slot) as r from {RUNS}) where r = 1")
def h10_best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    still = spans.stationarity(tracks(spark, sf_dir), ["cam", "slot"], 1.0, 5.0)
    runs = spans.dwell_runs(still, ["cam", "slot"])
    best = F.struct("dwell_s", "span_s", (-F.col("motion_px")).alias("m"), (-F.col("slot")).alias("s"))
    return runs.groupBy("cam", "frame_idx").agg(F.max_by("slot", best).alias("slot"), r6(F.max("dwell_s")).alias("dwell_s"))


@query(f"""with r as (select cam, slot, mono_ts, case when mono_ts - lag(mono_ts) over w > 0.5::double then 1 else 0 end as fresh from {D} window w as (partition by cam, slot order by mono_ts)),
i as (select *, sum(fresh) over (partition by cam, slot order by mono_ts) as span_no from r)
select cam, slot, span_no::bigint as span_no, min(mono_ts) as raw_start_s, max(mono_ts) as raw_end_s, count(*) as n_samples from i group by 1, 2, 3""")
def h3_presence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.raw_spans(tracks(spark, sf_dir), ["cam", "slot"], 0.5, "mono_ts").drop("times_")


SPANS = f"""(with r as (select cam, slot, mono_ts, case when mono_ts - lag(mono_ts) over w > 0.5::double then 1 else 0 end as fresh from {D} window w as (partition by cam, slot order by mono_ts)),
i as (select *, sum(fresh) over (partition by cam, slot order by mono_ts) as span_no from r),
g as (select cam, slot, span_no, greatest(0, min(mono_ts) - 1) as a, least(200, max(mono_ts) + 1) as b, list(mono_ts) as times from i group by 1, 2, 3),
p as (select *, unnest(case when b - a > 8 then range(0, ceil((b - a) / 8)::int) else [0] end) as part from g where b - a >= 2.5::double),
q as (select *, a + 8 * part as start_s, case when b - a > 8 then least(a + 8 * part + 8, b) else b end as end_s from p where part = 0 or a + 8 * part < b - 1e-9)
select cam, slot, span_no::bigint as span_no, part, least(999, round_even(start_s * 5, 0))::bigint as start_frame, least(999, round_even(end_s * 5, 0))::bigint as end_frame,
  round(start_s, 6) as start_s, round(end_s, 6) as end_s, len(list_filter(times, lambda t: t >= start_s - 1e-9 and t <= end_s + 1e-9)) as n_samples from q)"""


def padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.spans(tracks(spark, sf_dir), ["cam", "slot"], views.FPS, views.PER_CAMERA, merge_gap_s=0.5, min_len_s=2.5, max_len_s=8.0, time="mono_ts")


@query(f"select * from {SPANS}")
def h4_padded_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = padded(spark, sf_dir)
    return rows.withColumns({"start_s": r6("start_s"), "end_s": r6("end_s")})


@query(f"""with s as (select cam, start_frame, end_frame from {SPANS}),
c as (select *, case when start_frame > max(end_frame) over (partition by cam order by start_frame, end_frame rows between unbounded preceding and 1 preceding) + 1 then 1 else 0 end as fresh from s),
k as (select *, sum(fresh) over (partition by cam order by start_frame, end_frame rows unbounded preceding) as chain from c)
select cam, min(start_frame) as start_frame, max(end_frame) as end_frame, count(*) as n_merged from k group by cam, chain""")
def h5_merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.intervals import merged_ranges

    return merged_ranges(padded(spark, sf_dir).select("cam", "start_frame", "end_frame"), ["cam"])
