"""Queries over tracks, dwell events and what belongs to them; tables read back from their sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.boxes import Box
from ..lineage import shared_folder
from ..operators import dwell, events, scoring, spans, tracking
from ..operators.intervals import merged_ranges
from ..sources import metadata
from . import views
from .registry import query, r6

D, E, C, FR, R = views.DETECTIONS, views.EVENTS, views.CLIPS, views.FRAMES, views.RANGES


def sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Frames and detections by source."""
    frames = views.frames(spark, sf_dir).select(F.col("cam").cast("string").alias("source"), "frame_idx", "mono_ts")
    rows = views.detections(spark, sf_dir).withColumn("source", F.col("cam").cast("string"))
    return frames, rows.select("source", "frame_idx", "mono_ts", "det_rank", *Box._fields, "confidence", "class_name")


def tracked(spark: SparkSession, sf_dir: str, **how) -> tuple[DataFrame, DataFrame]:
    return tracking.tracked(*sources(spark, sf_dir), **{"max_age": 5, **how})


@query()
def k1_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracked(spark, sf_dir)[0].select("source", "frame_idx", "det_rank", "track_id")


@query()
def k2_dwell_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dwell.dwell_events(*sources(spark, sf_dir), dwell.Settings(1.0, 2.0, 1.0), 5.0, 5).withColumn("track_ids", F.array_join("track_ids", ","))


@query()
def k4_near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dwell.dwell_events(*sources(spark, sf_dir), dwell.Settings(1.0, 9.0, 1.0, near_misses=True), 5.0, 5)
    return found.select("source", "start_frame", "end_frame", "near_miss", r6("confidence").alias("confidence"))


@query()
def k8_track_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, state = tracked(spark, sf_dir, center_gate=1.5)
    return state.select("source", "frame_idx", "n_active").join(found.groupBy("source", "frame_idx").agg(F.count("*").alias("n_boxes")), ["source", "frame_idx"], "left").fillna(0, ["n_boxes"])


@query()
def g9_track_fragmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = tracked(spark, sf_dir)
    padded = spans.spans(found, ["source", "track_id"], views.FPS, views.PER_CAMERA, time="mono_ts")
    merged = merged_ranges(padded.select("source", "start_frame", "end_frame"), ["source"]).groupBy("source").agg(F.count("*").alias("n_windows"))
    counts = found.groupBy("source").agg(F.count_distinct("track_id").alias("n_tracks"), F.count("*").alias("n_detections"))
    rows = counts.join(padded.groupBy("source").agg(F.count("*").alias("n_spans")), "source").join(merged, "source")
    return rows.withColumn("spans_per_window", r6(F.col("n_spans") / F.col("n_windows")))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event for each block of a camera's first subject."""
    return views.ranges(spark, sf_dir).select(F.concat_ws("/", "clip", "blk").alias("event_key"), F.col("clip").alias("source"), F.col("start_s").alias("start_wall_s"), F.col("end_s").alias("end_wall_s"), F.col("start_s").alias("first_mono"), (F.col("end_s") - F.col("blk") % 3).alias("last_mono"), F.lit("1").alias("primary_track_id"))


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    stills = views.frames(spark, sf_dir).select(F.col("cam").alias("source"), "frame_idx", "mono_ts", F.col("mono_ts").alias("wall_s"))
    return events.windows(event_rows(spark, sf_dir), stills, 1.0, 2.0, 1.5)


EV = f"(select clip::varchar || '/' || blk::varchar as event_key, clip as source, start_s, end_s, end_s - blk % 3 as last_mono from {R})"
WINDOWS = f"""(with w as (select event_key, source, frame_idx, mono_ts >= start_s - 1 and mono_ts <= end_s + 2 as wall, mono_ts >= start_s - 1 and mono_ts <= last_mono + 2 + 1.5::double as mono from {EV} e join {FR} f on f.cam = e.source),
n as (select *, count(case when wall then 1 end) over (partition by event_key) as nw, count(case when mono then 1 end) over (partition by event_key) as nm from w)
select event_key, source, frame_idx, case when nm > nw then 'mono' else 'wall' end as "by" from n where case when nm > nw then mono else wall end)"""


@query(f"select * from {WINDOWS}")
def f10_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_frames(spark, sf_dir)


@query(f"""with b as (select w.event_key, w.frame_idx, d.slot, row_number() over (partition by w.event_key, w.frame_idx order by coalesce(d.slot = 1, false) desc, d.confidence desc, (x2-x1)*(y2-y1) desc, d.det_rank) as r from {WINDOWS} w left join {D} d on d.cam = w.source and d.frame_idx = w.frame_idx)
select event_key, frame_idx, row_number() over (partition by event_key order by frame_idx) - 1 as frame_no, case when slot is not null then count(slot) over (partition by event_key order by frame_idx) - 1 end::double as crop_no from b where r = 1""")
def f11_event_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_frames(spark, sf_dir).withColumns({"width": F.lit(views.WIDTH), "height": F.lit(views.HEIGHT)})
    dets = views.detections(spark, sf_dir).withColumns({"source": F.col("cam"), "track_id": F.col("slot").cast("string")})
    return events.crops(rows, dets, event_rows(spark, sf_dir)).select("event_key", "frame_idx", "frame_no", F.col("crop_no").cast("double").alias("crop_no"))


@query(f"select cam as source, frame_idx from (select *, max(mono_ts) over (partition by cam) as newest, row_number() over (partition by cam order by mono_ts desc) as r from {FR}) where mono_ts >= newest - 10 and r <= 40")
def h14_look_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.look_back(views.frames(spark, sf_dir).withColumnRenamed("cam", "source"), 10.0, 40).select("source", "frame_idx")


@query()
def f7_chunk_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans seen by two chunks that overlap: every span that reaches over a chunk's end is found again in the next."""
    e = views.events(spark, sf_dir)
    a, b = F.col("start_s"), F.col("start_s") + 4 + F.col("event_key") % 5
    chunk = F.floor(a / 600) * 600.0
    own = e.select("camera_id", (F.col("event_key") * 2).alias("span_id"), chunk.alias("chunk_start_s"), (a - chunk).alias("start_s"), (b - chunk).alias("end_s"))
    again = e.filter(b > chunk + 600).select("camera_id", (F.col("event_key") * 2 + 1).alias("span_id"), (chunk + 600).alias("chunk_start_s"), F.greatest(a - chunk - 600, F.lit(-2.0)).alias("start_s"), (b - chunk - 600).alias("end_s"))
    return spans.without_chunk_repeats(own.unionByName(again), ["camera_id"], 10.0, 600.0).select("span_id")


# --- sources and sinks


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"select camera_id, count(*) as n, sum(case when label_status = 'labeled' then 1 else 0 end)::bigint as n_labeled from {E} group by 1")
def a11_event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.events(spark, sf_dir)
    at = F.timestamp_micros((F.col("start_s") * 1e6).cast("long"))
    path = folder(spark, "events")
    metadata.write_events(rows.withColumns({"camera_dir": F.concat(F.lit("cam"), F.col("camera_id")), "date_dir": F.date_format(at, "yyyy-MM")}), path)
    return spark.read.parquet(path).groupBy("camera_id").agg(F.count("*").alias("n"), F.count_if(F.col("label_status") == "labeled").alias("n_labeled"))


@query(f"select clip, count(*) as n_ranges, min(start_frame) as first_frame from {R} where start_frame >= 0 and end_frame >= start_frame group by 1")
def a14_label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import labels

    good, _ = labels.validated(labels.renewed_times(views.ranges(spark, sf_dir), views.clips(spark, sf_dir)))
    path = folder(spark, "labels")
    metadata.write_labels(good, path)
    return spark.read.parquet(path).groupBy("clip").agg(F.count("*").alias("n_ranges"), F.min("start_frame").alias("first_frame"))


@query(f"select 'cam' || cam::varchar as camera_id, 'Name ' || (cam + 1)::varchar as camera_name from (select distinct cam from {D})")
def a5_camera_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    cams = views.detections(spark, sf_dir).select("cam").distinct()
    text = lambda n: F.to_json(F.create_map(F.concat(F.lit("cam"), F.col("cam").cast("string")), F.concat(F.lit("Name "), (F.col("cam") + n).cast("string"))))
    texts = cams.select(F.lit(1).alias("seq"), text(0).alias("value")).unionByName(cams.select(F.lit(2).alias("seq"), text(1).alias("value"))).unionByName(cams.select(F.lit(3).alias("seq"), F.lit("{broken").alias("value")))
    return metadata.camera_names(texts)


@query("select (l_suppkey % 8)::int as source, count(*) as n, sum(case when l_linenumber = 1 then 0 else l_quantity::int end)::bigint as bytes, count(case when l_linenumber <> 2 then 1 end) as n_timed, count(case when l_returnflag = 'R' then 1 end) as n_key from lineitem group by 1")
def a6_packet_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = views.table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    packet = F.struct(F.when(n > 3, (F.col("l_orderkey") / 10).cast("string")).alias("pts_time"), F.when(n == 2, "N/A").otherwise(F.col("l_orderkey").cast("string")).alias("dts_time"), F.when(n == 1, "bad").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("size"), F.when(F.col("l_returnflag") == "R", "K__").otherwise("___").alias("flags"))
    texts = line.select((F.col("l_suppkey") % 8).cast("int").alias("source"), F.to_json(F.struct(F.array(packet).alias("packets"))).alias("value"))
    found = metadata.parsed_packets(texts)
    return found.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.count("pts_time").alias("n_timed"), F.count_if("is_keyframe").alias("n_key"))


@query(f"select cam, slot::varchar as track_id, count(*) as n, round(sum(confidence), 4) as confidence from {D} group by 1, 2")
def a10_nested_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct("frame_idx", F.struct(*Box._fields).alias("bbox"), "confidence")
    nested = views.detections(spark, sf_dir).groupBy("cam", F.col("slot").cast("string").alias("track_id")).agg(F.collect_list(one).alias("detections"))
    nested = nested.groupBy("cam").agg(F.collect_list(F.struct("track_id", "detections")).alias("tracks"))
    rows = nested.select("cam", F.inline("tracks")).select("cam", "track_id", F.inline("detections"))
    return rows.groupBy("cam", "track_id").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


@query(f"""select clip, blk, end_frame - start_frame + 1 as frame_count, round(1700000000 + start_s, 6) as span_start_s, n as n_detections, first as first_clip_frame, 'clip_frames' as timebase from {R} r
join (select cam, cast(floor(frame_idx / 60) as int) as b, count(*) as n, min(frame_idx) as f from {D} where slot = 1 group by 1, 2) d on d.cam = r.clip and d.b = r.blk, lateral (select f - start_frame as first)""")
def a13_clip_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets = views.detections(spark, sf_dir).filter("slot = 1").select(F.col("cam").alias("clip"), "frame_idx", *Box._fields, "confidence")
    rows = views.ranges(spark, sf_dir).join(dets, "clip").filter("frame_idx between start_frame and end_frame")
    item = F.struct((F.col("frame_idx") - F.col("start_frame")).alias("clip_frame_idx"), F.col("frame_idx").alias("source_frame_idx"), F.struct(*Box._fields).alias("bbox"), "confidence")
    clips = rows.groupBy("clip", "blk", "start_frame", "end_frame", "start_s").agg(F.array_sort(F.collect_list(item)).alias("detections"))
    return clips.select("clip", "blk", (F.col("end_frame") - F.col("start_frame") + 1).alias("frame_count"), r6(1_700_000_000 + F.col("start_s")).alias("span_start_s"), F.size("detections").cast("long").alias("n_detections"), F.get("detections", F.lit(0))["clip_frame_idx"].alias("first_clip_frame"), F.lit("clip_frames").alias("timebase"))


# --- the caller's models


@query(f"select cam, frame_idx, count(*) as n from {D} where slot = 1 and q % 2 = 0 group by 1, 2")
def n1_box_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make():
        return lambda frames: [[{"x1": f["x1"], "y1": f["y1"], "x2": f["x2"], "y2": f["y2"], "confidence": f["confidence"], "class_name": "dog"}] if f["q"] % 2 == 0 else [] for f in frames]

    rows = views.detections(spark, sf_dir).filter("slot = 1")
    return scoring.scored(rows, make, ["cam", "frame_idx"]).groupBy("cam", "frame_idx").agg(F.count("*").alias("n"))


@query(f"select cam, frame_idx, case when q % 10 = 0 then 'infer_error' when q % 10 = 1 then 'infer_none' else 'success' end as outcome from {D} where slot = 1")
def n2_pose_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make():
        def model(crops):
            if any(c["q"] % 10 == 0 for c in crops):
                raise ValueError("a crop that fails")
            return [None if c["q"] % 10 == 1 else {"nose_x": c["x1"]} for c in crops]

        return model

    rows = views.detections(spark, sf_dir).filter("slot = 1")
    return scoring.estimated(rows, make, ["cam", "frame_idx"], "nose_x double").select("cam", "frame_idx", "outcome")


@query(f"select cam, cast(floor(frame_idx / 60) as int) as blk, case when count(*) > 30 then 'poop' else 'pee' end as guess, true as needs_label from {D} where slot = 1 group by 1, 2")
def n3_event_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.detections(spark, sf_dir).filter("slot = 1").withColumn("blk", F.floor(F.col("frame_idx") / views.BLOCK).cast("int"))
    return scoring.classified(rows, ["cam", "blk"], lambda pdf: ("poop" if len(pdf) > 30 else "pee", 0.5)).select("cam", "blk", "guess", "needs_label")


class ByPlace:
    """A tracker of another kind: the left half of the frame is track 1, the right half track 2."""

    def __init__(self):
        self.numbers, self.born = [], 0

    def update(self, boxes, confidence):
        import numpy as np

        self.numbers, self.born = [1, 2], 2
        return np.where(boxes[:, 0] < 640, 1, 2) if len(boxes) else np.zeros(0, int)


@query(f"""with b as (select cam, frame_idx, x1 < 640 as is_left, case when frame_idx - lag(frame_idx) over (partition by cam order by frame_idx) < 7 then null else frame_idx + 1 end as begun from {D}),
s as (select *, max(begun) over (partition by cam order by frame_idx)::bigint as segment from b)
select cam::varchar as source, segment, count(distinct is_left) as n_tracks, count(*) as n from s group by 1, 2""")
def n4_custom_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = tracking.tracked(*sources(spark, sf_dir), max_age=5, make=ByPlace)
    return found.groupBy("source", "segment").agg(F.count_distinct("track_id").alias("n_tracks"), F.count("*").alias("n"))
