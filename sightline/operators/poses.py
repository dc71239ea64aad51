"""Posture features of a window, the guess from boxes alone, and the trailing posture gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import boxes, posture, timebase
from ..functions.boxes import Box
from ..lineage import settled
from .gates import best_per_frame


def frame_features(poses: DataFrame, min_conf: float = 0.5, min_torso: int = 3, keep: list[str] | None = None) -> DataFrame:
    """poses (points, crop_bbox, ...) that have enough torso points, with scale (null: not usable), quality, the features
    of the frame, and the centroid. keep: columns of poses that come along (all). A batch is computed at once: as
    columns the expressions are more code than the JVM compiles."""
    keep = poses.columns if keep is None else keep
    extra = StructType.fromDDL(posture.FRAME)
    rows = poses.select(*keep, F.col("points").alias("points_"), F.col("crop_bbox").alias("crop_"))
    schema = StructType([*rows.schema.fields[: len(keep)], *extra.fields])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made, torso = posture.frames(batch.column(len(keep)), batch.column(len(keep) + 1), min_conf)
            whole = pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*keep, *extra.fieldNames()])
            yield whole.filter(pa.array(torso >= min_torso))

    return rows.mapInArrow(run, schema)


def window_features(poses: DataFrame, keys: list[str], min_conf: float = 0.5, min_frames: int = 3, min_coverage: float = 0.5, min_torso: int = 3, order: str = "mono_ts") -> DataFrame:
    """One row for each window (keys) with a usable pose: medians, extremes, coverage, support counts, what is missing,
    and whether to fall back to the boxes."""
    totals = poses.groupBy(*keys).agg(F.count("*").alias("n_frames_total"))
    rows = settled(frame_features(poses, min_conf, min_torso, [*keys, order]))  # read twice below
    at = F.when(F.col("scale").isNotNull(), F.col(order))
    base = rows.groupBy(*keys).agg(
        F.count("scale").alias("n_frames_valid"), (F.max(at) - F.min(at)).alias("dwell_duration_s"), F.percentile("scale", 0.5).alias("body_scale_px"),
        F.max(F.when(F.col("quality") == "torso", "torso")).alias("q_"),
        *(F.percentile(f, 0.5).alias(f) for f in posture.FEATURES), *(F.count(f).alias(f"n_{f}") for f in posture.FEATURES),
        F.min("hip_offset_ratio").alias("hip_offset_min"), F.max("hip_offset_ratio").alias("hip_offset_max"),
        F.count("centroid").alias("n_centroid_motion_ratio"), F.min_by("centroid", F.when(F.col("centroid").isNotNull(), F.col(order))).alias("origin"),
    ).filter("n_frames_valid > 0")
    far = rows.select(*keys, "centroid").join(base.select(*keys, "origin"), keys)
    dx, dy = F.col("centroid.x") - F.col("origin.x"), F.col("centroid.y") - F.col("origin.y")
    far = far.groupBy(*keys).agg(F.max(F.sqrt(dx * dx + dy * dy)).alias("far_"))
    out = base.join(totals, keys).join(far, keys).withColumn("coverage", F.col("n_frames_valid") / F.col("n_frames_total"))
    quality = F.coalesce("q_", F.lit("bbox_fallback"))
    names = [*posture.FEATURES, "centroid_motion_ratio"]
    return out.select(
        *keys, "n_frames_total", "n_frames_valid", "coverage", "dwell_duration_s", "body_scale_px", quality.alias("body_scale_quality"), *posture.FEATURES, "hip_offset_min", "hip_offset_max",
        F.when(F.col("n_hip_offset_ratio") >= 2, F.col("hip_offset_max") - F.col("hip_offset_min")).alias("squat_depth_change"),
        F.when((F.col("n_centroid_motion_ratio") >= 2) & (F.col("body_scale_px") > 0), F.col("far_") / F.col("body_scale_px")).alias("centroid_motion_ratio"),
        F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"n_{n}").cast("int"))]).alias("support"),
        F.filter(F.array(*(F.when(F.col(f"n_{n}") == 0, n) for n in names)), lambda n: n.isNotNull()).alias("missing"),
        ((F.col("n_frames_valid") < min_frames) | (F.col("coverage") < min_coverage) | (quality != "torso")).alias("fallback"),
    )


def box_guess(detections: DataFrame, keys: list[str], order: str = "mono_ts", long_s: float = 5.0, deep: float = 0.35) -> DataFrame:
    """A weak guess from a track's boxes: long and deep is poop; any time or movement is pee; else unknown."""
    h, w = boxes.height(Box.of()), boxes.width(Box.of())
    aspect = F.when(h > 0, w / h)
    by = detections.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(order) - F.min(order)).alias("duration_s"), F.max(h).alias("high"), F.min(h).alias("low"), F.max(aspect).alias("wide"), F.min(aspect).alias("slim"))
    drop = F.when(F.col("high") > 0, F.greatest(F.lit(0.0), (F.col("high") - F.col("low")) / F.col("high"))).otherwise(0.0)
    change = F.when(F.col("slim") > 0, F.greatest(F.lit(0.0), (F.col("wide") - F.col("slim")) / F.col("slim"))).otherwise(0.0)
    by = by.withColumn("depth", F.greatest(drop, change))
    made = lambda g, c: F.struct(F.lit(g).alias("guess"), c.alias("confidence"))
    s, d = F.col("duration_s"), F.col("depth")
    out = (
        F.when(F.col("n") < 2, made("unknown", F.lit(0.0))).when((s >= long_s) & (d >= deep), made("poop", F.least(F.lit(0.65), 0.45 + 0.15 * d + 0.02 * s)))
        .when((s > 0) | (d > 0), made("pee", F.least(F.lit(0.6), 0.35 + 0.10 * d + 0.01 * s))).otherwise(made("unknown", F.lit(0.2)))
    )
    return by.select(*keys, "duration_s", "depth", out.alias("g_")).select(*keys, "duration_s", "depth", "g_.*")


def guesses(features: DataFrame, by_boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The posture's guess where its features are trusted and telling, else the boxes'; always for review."""
    f = features.select(*keys, "fallback", posture.decision(*(F.col(c) for c in ("spine_angle_deg", "hip_offset_ratio", "centroid_motion_ratio", "tail_angle_deg", "dwell_duration_s", "hind_paw_asymmetry"))).alias("p_"))
    rows = by_boxes.select(*keys, F.struct("guess", "confidence").alias("b_")).join(f, keys, "left")
    chosen = posture.guess(F.col("p_"), F.coalesce(~F.col("fallback"), F.lit(False)), F.col("b_"))
    return rows.select(*keys, chosen.alias("g_"), (F.coalesce(~F.col("fallback"), F.lit(False)) & F.col("p_").isNotNull()).alias("by_posture")).select(*keys, "g_.guess", "g_.confidence", "by_posture", F.lit(True).alias("needs_label"))


def gated(detections: DataFrame, poses: DataFrame, keys: list[str], window_s: float, min_frames: int = 3, min_coverage: float = 0.5, **how) -> DataFrame:
    """For each box: what the trailing window's poses say (squat, still), null where they are too few or too poor.
    poses: keys, frame_idx, points (null: tried without result), crop_bbox. Attempts, not successes, are the base of
    the coverage."""
    tried = detections.select(*keys, "frame_idx", "mono_ts").join(poses.select(*keys, "frame_idx", "points", "crop_bbox").withColumn("tried_", F.lit(1)), [*keys, "frame_idx"])
    ends = detections.select(*keys, F.col("frame_idx").alias("at_frame"), F.col("mono_ts").alias("at_"))
    bucket = lambda c: F.floor(c / window_s).cast("long")
    near = ends.withColumn("k_", F.explode(F.array(bucket(F.col("at_")), bucket(F.col("at_")) - 1))).join(tried.withColumn("k_", bucket(F.col("mono_ts"))), [*keys, "k_"])
    near = near.filter((F.col("mono_ts") <= F.col("at_")) & (F.col("mono_ts") >= F.col("at_") - window_s))
    counts = near.groupBy(*keys, "at_frame").agg(F.count("*").alias("attempted"), F.count("points").alias("usable"))
    found = window_features(near.filter("points is not null"), [*keys, "at_frame"], min_frames=min_frames, min_coverage=min_coverage, **how).filter("not fallback")
    rows = counts.filter((F.col("usable") >= min_frames) & (F.col("usable") / F.col("attempted") >= min_coverage)).join(found, [*keys, "at_frame"])
    core = F.col("spine_angle_deg").isNotNull() | F.col("hip_offset_ratio").isNotNull()
    squat = F.when(core, F.coalesce(F.col("spine_angle_deg") < 150.0, F.lit(False)) | F.coalesce(F.col("hip_offset_ratio") > 0.12, F.lit(False)))
    return rows.select(*keys, F.col("at_frame").alias("frame_idx"), "attempted", "usable", squat.alias("squat"), (F.col("centroid_motion_ratio") < 0.6).alias("still")).filter("squat is not null or still is not null")


def poses_to_compute(detections: DataFrame, keys: list[str], cap: int = 30) -> DataFrame:
    """At most cap frames of each event, evenly over its time, with the best box of each."""
    best = best_per_frame(detections, [*keys, "frame_idx"])
    rows = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("frame_idx", *Box._fields))).alias("f_"))
    return rows.select(*keys, F.inline(timebase.evenly(F.col("f_"), cap)))


def telemetry(calls: DataFrame, window: int = 2048) -> DataFrame:
    """Of pose calls (source, ts, call_id, outcome, latency_ms, mean_conf, frac_ge, n_keypoints): calls by outcome,
    success rate, lifetime latency, exact percentiles over the last window latencies, mean health of successes."""
    ok = F.col("outcome") == "success"
    outcomes = ("success", "skip_tiny_crop", "build_failed", "infer_error", "infer_none", "bad_shape", "no_finite_keypoints")  # fixed values
    totals = calls.groupBy("source").agg(
        F.count("*").alias("total_calls"), *(F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in outcomes), F.count("latency_ms").alias("latency_count"), F.avg("latency_ms").alias("latency_mean"), F.min("latency_ms").alias("latency_min"), F.max("latency_ms").alias("latency_max"),
        *((F.sum(F.when(ok, F.col(c))) / F.nullif(F.count_if(ok), F.lit(0))).alias(f"mean_{c}") for c in ("mean_conf", "frac_ge", "n_keypoints")),
    )
    # The last calls of a source: hours that are newer count as a whole, so only the hour that the window begins in is
    # looked at call by call.
    timed = calls.filter("latency_ms is not null").withColumn("hour_", F.floor(F.col("ts").cast("double") / 3600))
    newer = Window.partitionBy("source").orderBy(F.col("hour_").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    hours = timed.groupBy("source", "hour_").agg(F.count("*").alias("n_"))
    hours = hours.select(F.col("source").alias("s_"), F.col("hour_").alias("h_"), F.coalesce(F.sum("n_").over(newer), F.lit(0)).alias("newer_")).filter(F.col("newer_") < window)
    latest = Window.partitionBy("source", "hour_").orderBy(F.col("ts").desc(), F.col("call_id").desc())
    last = timed.join(hours, F.col("source").eqNullSafe(F.col("s_")) & F.col("hour_").eqNullSafe(F.col("h_")))
    last = last.withColumn("r_", F.row_number().over(latest) + F.col("newer_")).filter(F.col("r_") <= window)
    last = last.groupBy("source").agg(*(F.percentile("latency_ms", p / 100).alias(f"latency_p{p}") for p in (50, 95, 99)))
    return totals.join(last, "source", "left").withColumn("success_rate", F.col("n_success") / F.col("total_calls"))


def run_summary(frames: DataFrame) -> DataFrame:
    """Of scored frames (source, latency_ms, batch, n_boxes): counts, latency, rates, effective batch size."""
    per_batch = frames.groupBy("source", "batch").agg(F.count("*").alias("size"), F.sum("latency_ms").alias("ms"), F.sum("n_boxes").alias("boxes"))
    sizes = per_batch.groupBy("source").agg(F.count("*").alias("batches"), F.avg("size").alias("mean_batch"), F.max("size").alias("max_batch"))
    whole = frames.groupBy("source").agg(F.count("*").alias("frames"), F.sum("n_boxes").alias("boxes"), F.avg("latency_ms").alias("mean_latency_ms"), F.percentile("latency_ms", 0.95).alias("p95_latency_ms"), F.sum("latency_ms").alias("ms_"))
    return whole.join(sizes, "source").withColumn("fps", F.when(F.col("ms_") > 0, F.col("frames") * 1000.0 / F.col("ms_"))).drop("ms_")


def overlay_join(crops: DataFrame, poses: DataFrame, keys: list[str]) -> DataFrame:
    """Crops with their pose, if one was tried: attempted, and points."""
    return crops.join(poses.select(*keys, "points").withColumn("attempted", F.lit(True)), keys, "left").withColumn("attempted", F.coalesce("attempted", F.lit(False)))


def seen_points(points: Column, least: float) -> Column:
    return F.size(F.filter(F.map_values(points), lambda p: p["confidence"] >= least))
