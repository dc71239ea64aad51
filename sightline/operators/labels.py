"""Labelled frame ranges to a training manifest without leaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes, keys, timebase
from ..functions.boxes import Box

CLIP = ["clip"]


def validated(ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) ranges: clip, start_frame, end_frame, start_s, end_s, behavior, ...; bad ones get a reason."""
    marked = ranges.withColumn("reason", keys.bad_range(*(F.col(c) for c in ("start_frame", "end_frame", "start_s", "end_s"))))
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def renewed_times(ranges: DataFrame, clips: DataFrame) -> DataFrame:
    """ranges with start_s, end_s and time_basis derived from frames by their clip's timeline."""
    timeline = clips.select("clip", F.col("fps").alias("f_"), F.col("frame_count").alias("n_"), F.col("frame_times_s").alias("t_"))
    at = lambda c: timebase.frame_seconds(F.col(c), F.col("f_"), F.col("n_"), F.col("t_"))
    rows = ranges.join(timeline, "clip").withColumns({"start_s": at("start_frame"), "end_s": at("end_frame"), "time_basis": F.when(F.col("t_").isNull(), "clip_frames").otherwise("clip_pts")})
    return rows.drop("f_", "n_", "t_")


def sampled(ranges: DataFrame, clips: DataFrame, stride_s: float = 0.5, cap: int = 40) -> DataFrame:
    """One row for each frame of a trainable range to export: range columns and frame_idx."""
    timeline = clips.select("clip", F.col("fps").alias("f_"), F.col("frame_count").alias("n_"), F.col("frame_times_s").alias("t_"))
    frames = timebase.stride_frames(F.col("start_frame"), F.col("end_frame"), F.lit(stride_s), F.col("f_"), F.col("n_"), F.col("t_"), cap)
    return ranges.filter(keys.is_trainable(F.col("behavior"))).join(timeline, "clip").withColumn("frame_idx", F.explode(frames)).drop("f_", "n_", "t_")


def with_reference(samples: DataFrame, references: DataFrame) -> DataFrame:
    """samples with reference (struct x1..y2): the box of the same clip and track nearest in frames, the earlier of two
    as near; null without a track. references: clip, track_id, ref_idx, x1..y2.

    Samples and references of a track are put in one order and each sample looks to the last reference before it and
    the first after it, so no pair is ever built."""
    box = F.struct(*Box._fields)
    refs = references.select("clip", "track_id", F.col("ref_idx").alias("at_"), box.alias("b_")).groupBy("clip", "track_id", "at_").agg(F.first("b_").alias("b_"))
    asked = samples.filter("track_id is not null").select("clip", "track_id", F.col("frame_idx").alias("at_")).distinct()
    line = refs.withColumn("asks_", F.lit(False)).unionByName(asked.select("*", F.lit(None).cast(refs.schema["b_"].dataType).alias("b_"), F.lit(True).alias("asks_")))
    order = Window.partitionBy("clip", "track_id").orderBy("at_", "asks_")
    known = F.when(F.col("b_").isNotNull(), F.struct("at_", "b_"))
    line = line.withColumns({"p_": F.last(known, True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "q_": F.first(known, True).over(order.rowsBetween(1, Window.unboundedFollowing))})
    nearest = F.when(F.col("q_").isNull() | (F.col("at_") - F.col("p_.at_") <= F.col("q_.at_") - F.col("at_")), F.col("p_.b_")).otherwise(F.col("q_.b_"))
    found = line.filter("asks_").select("clip", "track_id", F.col("at_").alias("frame_idx"), F.coalesce(nearest, F.col("p_.b_"), F.col("q_.b_")).alias("reference"))
    return samples.join(found, ["clip", "track_id", "frame_idx"], "left")


def picked(samples: DataFrame, detections: DataFrame, min_iou: float = 0.1) -> DataFrame:
    """samples (with sample_id and reference) with box and matched: the detection of the frame that overlaps the
    reference best, if at least by min_iou; without a reference the surest. detections: clip, frame_idx, det_rank,
    x1..y2, confidence."""
    dets = detections.select("clip", "frame_idx", F.struct(*Box._fields).alias("d_"), "confidence", "det_rank")
    pairs = samples.select("sample_id", "clip", "frame_idx", "reference").join(dets, ["clip", "frame_idx"])
    shared = F.when(F.col("reference").isNull(), F.lit(None).cast("double")).otherwise(boxes.iou(Box.of("reference"), Box.of("d_")))
    rank = F.struct(F.coalesce(shared, F.col("confidence")).alias("s"), (-F.col("det_rank")).alias("r"))
    best = pairs.withColumn("iou_", shared).groupBy("sample_id").agg(F.max_by(F.struct("d_", "iou_"), rank).alias("m_"))
    rows = samples.join(best, "sample_id", "left")
    fine = F.col("m_").isNotNull() & (F.col("m_.iou_").isNull() | (F.col("m_.iou_") >= min_iou))
    return rows.withColumns({"box": F.when(fine, F.col("m_.d_")), "matched": fine}).drop("m_")


def manifest(picked_rows: DataFrame, clips: DataFrame, val_fraction: float = 0.2, margin: float = 0.35) -> DataFrame:
    """One row for each accepted crop. clips: source_id, day, width, height beside the timeline."""
    about = clips.select("clip", "source_id", "day", "width", "height")
    rows = picked_rows.filter("matched").join(about, "clip")
    crop = boxes.crop_rectangle(Box.of("box"), margin, F.col("width"), F.col("height"))
    rows = rows.withColumns({"crop": crop, "split": keys.split_of(keys.split_key(F.col("source_id"), F.col("day")), val_fraction)}).filter("not crop.is_empty")
    stem = F.concat(F.col("clip").cast("string"), F.lit("_f"), F.lpad(F.col("frame_idx").cast("string"), 6, "0"), F.lit("_t"), F.coalesce("track_id", F.lit("None")), F.lit(".jpg"))
    known = F.col("name") != "unknown"
    return rows.select(
        F.concat_ws("/", F.lit("behavior"), "split", "behavior", stem).alias("behavior_path"), F.when(known, F.concat_ws("/", F.lit("dog"), "split", "name", stem)).otherwise("").alias("name_path"),
        "behavior", "name", F.coalesce("track_id", F.lit("")).alias("track_id"), "clip", "source_id", "day", "split", F.lit(1).alias("matched"), "frame_idx", "crop",
    )


def export_stats(ranges: DataFrame, samples: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: ranges, excluded, sampled, written, unmatched, and counts by behaviour, known name and split."""
    count = lambda c, cond=None: F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))) if cond is None else None
    tally = lambda c, d: d.groupBy(c).agg(F.count("*").alias("n")).agg(count(c).alias(f"by_{c}"))
    base = ranges.agg(F.count("*").alias("ranges"), F.count_if(~keys.is_trainable(F.col("behavior"))).alias("excluded"))
    one = F.lit(True)
    out = base.join(samples.agg(F.count("*").alias("sampled")), one).join(rows.agg(F.count("*").alias("written")), one)
    for c, d in (("behavior", rows), ("name", rows.filter("name <> 'unknown'")), ("split", rows)):
        out = out.join(tally(c, d), one)
    return out.withColumn("unmatched", F.col("sampled") - F.col("written"))
