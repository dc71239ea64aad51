"""What belongs to an event: its frames, crops and records; its review rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes, keys
from ..functions.boxes import Box
from ..lineage import settled
from .intervals import chains, interval_join


def windows(events: DataFrame, frames: DataFrame, pre_s: float, post_s: float, event_duration_s: float, bucket_s: float = 60.0) -> DataFrame:
    """(event_key, source, frame_idx, by): the frames of each event by wall time, or by the frame clock where that
    window holds more. events: event_key, source, start_wall_s, end_wall_s, first_mono, last_mono; frames: source,
    frame_idx, mono_ts, wall_s."""
    stills = frames.select("source", "frame_idx", "mono_ts", "wall_s").dropDuplicates(["source", "frame_idx"])
    span = events.select("event_key", "source", (F.col("start_wall_s") - pre_s).alias("w0"), (F.col("end_wall_s") + post_s).alias("w1"), (F.col("first_mono") - pre_s).alias("m0"), (F.col("last_mono") + post_s + event_duration_s).alias("m1"))
    span, stills = settled(span), settled(stills)
    wall = interval_join(span, stills.withColumn("w_", F.col("wall_s")), ["source"], ("w0", "w1"), ("wall_s", "w_"), bucket_s)
    mono = interval_join(span, stills.withColumn("m_", F.col("mono_ts")), ["source"], ("m0", "m1"), ("mono_ts", "m_"), bucket_s)
    both = wall.select("event_key", "source", "frame_idx", F.lit("wall").alias("by")).unionByName(mono.select("event_key", "source", "frame_idx", F.lit("mono").alias("by")))
    sizes = both.groupBy("event_key").agg(F.count_if(F.col("by") == "wall").alias("n_wall"), F.count_if(F.col("by") == "mono").alias("n_mono"))
    chosen = sizes.select("event_key", F.when(F.col("n_mono") > F.col("n_wall"), "mono").otherwise("wall").alias("by"))
    return both.join(chosen, ["event_key", "by"])


def crops(event_frames: DataFrame, detections: DataFrame, events: DataFrame, margin: float = 0.35) -> DataFrame:
    """One row for each frame of an event: the primary track's best box, else the best of any; crops that are not empty
    are numbered without gaps. event_frames: event_key, source, frame_idx, width, height; detections: source,
    frame_idx, det_rank, track_id, x1..y2, confidence; events: event_key, primary_track_id."""
    rows = event_frames.join(events.select("event_key", "primary_track_id"), "event_key")
    dets = detections.select("source", "frame_idx", "det_rank", "track_id", "confidence", F.struct(*Box._fields).alias("box"))
    own = F.coalesce(F.col("track_id") == F.col("primary_track_id"), F.lit(False))
    rank = Window.partitionBy("event_key", "frame_idx").orderBy(own.desc(), F.col("confidence").desc(), boxes.area(Box.of("box")).desc(), "det_rank")
    best = rows.join(dets, ["source", "frame_idx"], "left").withColumn("r_", F.row_number().over(rank)).filter("r_ = 1").drop("r_", "det_rank")
    best = best.withColumn("crop", F.when(F.col("box").isNotNull(), boxes.crop_rectangle(Box.of("box"), margin, F.col("width"), F.col("height"))))
    order = Window.partitionBy("event_key").orderBy("frame_idx")
    full = F.col("crop").isNotNull() & ~F.col("crop.is_empty")
    number = F.sum(full.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    named = best.withColumns({"frame_no": F.row_number().over(order) - 1, "crop_no": F.when(full, number)})
    return named.withColumn("crop_path", F.when(F.col("crop_no").isNotNull(), F.concat(F.lit("crops/"), F.lpad(F.col("crop_no").cast("string"), 3, "0"), F.lit(".jpg"))))


def media_summary(media: DataFrame) -> DataFrame:
    """Of files (event_key, kind, name): for each event and kind count, first name and names, and the thumbnail (first
    crop, else first frame)."""
    by = media.groupBy("event_key", "kind").agg(F.count("*").alias("n"), F.min("name").alias("first_name"), F.array_sort(F.collect_list("name")).alias("names"))
    first = lambda k: F.min(F.when(F.col("kind") == k, F.col("name")))
    thumb = media.groupBy("event_key").agg(F.coalesce(first("crops"), first("frames")).alias("thumbnail"))
    return by.join(thumb, "event_key")


def reviewed(events: DataFrame, camera: str | None = None, status: str | None = "unlabeled", date: str | None = None) -> DataFrame:
    """events (camera_dir, camera_id, camera_name, date_dir, utc_ts, label_status) that a reviewer asks for."""
    out = events
    if camera is not None:
        wanted = F.lower(F.lit(camera))
        same = [F.coalesce(F.lower(c) == wanted, F.lit(False)) for c in ("camera_dir", "camera_id", "camera_name")]
        out = out.filter(same[0] | same[1] | same[2])
    if status is not None:
        out = out.filter(F.coalesce("label_status", F.lit("unlabeled")) == status)
    if date is not None:
        out = out.filter((F.col("date_dir") == date) | F.coalesce(F.col("utc_ts").startswith(date), F.lit(False)))
    return out


def page(events: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first, then by directory, backwards."""
    return events.orderBy(F.col("start_s").desc_nulls_last(), F.col("dir_name").desc()).offset(max(0, offset)).limit(min(500, max(1, limit)))


def totals(events: DataFrame, condition: Column) -> DataFrame:
    return events.agg(F.count("*").alias("total"), F.count_if(condition).alias("filtered"))


def newest_per_id(events: DataFrame) -> DataFrame:
    order = Window.partitionBy("event_id").orderBy(F.col("start_s").desc_nulls_last(), F.col("dir_name").desc())
    return events.withColumn("r_", F.row_number().over(order)).filter("r_ = 1").drop("r_")


def unseen(events: DataFrame, known: DataFrame) -> DataFrame:
    return events.join(known.select("event_id").distinct(), "event_id", "left_anti").orderBy(F.col("start_s").asc_nulls_first(), "event_id")


def scenes(clips: DataFrame) -> DataFrame:
    """clips (camera, span_id, start_s, end_s) with scene_id and scene_size: chains of windows that touch on one camera
    share a scene; a clip alone, or without a start, has none."""
    ends = clips.withColumn("e_", F.coalesce("end_s", "start_s"))
    found = chains(ends.filter("start_s is not null and camera is not null"), ["camera"], "start_s", "e_", name="scene_", ties=("span_id",))
    size = F.count("*").over(Window.partitionBy("camera", "scene_"))
    several = found.withColumn("n_", size).select("span_id", F.when(F.col("n_") > 1, F.concat(F.col("camera").cast("string"), F.lit("#"), F.col("scene_").cast("string"))).alias("scene_id"), F.col("n_").alias("scene_size"))
    return clips.join(several, "span_id", "left").withColumn("scene_size", F.coalesce("scene_size", F.lit(1)).cast("long"))


def class_counts(boxes_of: DataFrame, key: list[str]) -> DataFrame:
    """Boxes by class (missing: the subject), most first, then by name, as an array of structs."""
    by = boxes_of.groupBy(*key, F.coalesce("class_name", F.lit(keys.SUBJECT)).alias("class_name")).agg(F.count("*").alias("n"))
    item = F.struct((-F.col("n")).alias("m"), F.col("class_name"))
    return by.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["class_name"].alias("class_name"), (-x["m"]).alias("count"))).alias("classes"))


def clip_summaries(clips: DataFrame, clip_boxes: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row for each clip: duration, boxes, ranges, what is labelled."""
    n_boxes = clip_boxes.groupBy("clip").agg(F.count("*").alias("n_detections"))
    trainable = keys.is_trainable(F.col("behavior"))
    by = ranges.groupBy("clip").agg(F.count("*").alias("n_ranges"), F.count_if(trainable).alias("n_trainable"), F.array_sort(F.collect_set("behavior")).alias("behaviors"), F.array_sort(F.collect_set("name")).alias("names"))
    from ..functions.timebase import clip_duration

    rows = clips.withColumn("duration_s", F.round(clip_duration(F.col("fps"), F.col("frame_count"), F.col("frame_times_s")), 3))
    rows = rows.join(n_boxes, "clip", "left").join(by, "clip", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_detections", "n_ranges", "n_trainable")} | {c: F.coalesce(c, none) for c in ("behaviors", "names")})
    return rows.withColumn("labeled", F.col("n_trainable") > 0)


def label_queue(summaries: DataFrame) -> DataFrame:
    return summaries.orderBy("labeled", F.col("start_s").desc_nulls_last(), "span_id")


def siblings(clips: DataFrame, clip_boxes: DataFrame, chunk_s: float = 600.0) -> DataFrame:
    """Boxes of other clips of the same camera that fall into a clip's time, on its own frames: span_id, sibling_id,
    track_id, frame_idx. clips: camera, span_id, span_start_s, duration_s, fps, frame_count; clip_boxes: span_id,
    track_id, at_s (absolute)."""
    from ..functions.timebase import frame_nearest

    own = clips.select("camera", "span_id", "span_start_s", "duration_s", "fps", "frame_count", (F.col("span_start_s") - 1e-6).alias("a0"), (F.col("span_start_s") + F.col("duration_s") + 1e-6).alias("a1"))
    seen = clip_boxes.join(clips.select(F.col("span_id").alias("s_"), "camera"), clip_boxes["span_id"] == F.col("s_")).select("camera", F.col("s_").alias("sibling_id"), "track_id", "at_s", F.col("at_s").alias("at2_"))
    near = interval_join(own, seen, ["camera"], ("a0", "a1"), ("at_s", "at2_"), chunk_s).filter("span_id <> sibling_id")
    offset = F.col("at_s") - F.col("span_start_s")
    near = near.filter((offset >= -1e-9) & (offset <= F.col("duration_s") + 1e-9) & (F.col("fps") > 0) & (F.col("frame_count") > 0))
    return near.select("span_id", "sibling_id", "track_id", "at_s", frame_nearest(offset, F.col("fps"), F.col("frame_count")).alias("frame_idx"))


def look_back(frames: DataFrame, seconds: float, cap: int | None = None) -> DataFrame:
    """Frames within so many seconds of each source's newest, at most cap (the newest)."""
    newest = F.max("mono_ts").over(Window.partitionBy("source"))
    out = frames.withColumn("new_", newest).filter(F.col("mono_ts") >= F.col("new_") - seconds).drop("new_")
    if cap:
        order = Window.partitionBy("source").orderBy(F.col("mono_ts").desc(), F.col("frame_idx").desc())
        out = out.withColumn("r_", F.row_number().over(order)).filter(F.col("r_") <= cap).drop("r_")
    return out
