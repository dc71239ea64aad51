"""Cheap pre-filters by motion energy, and their score against exhaustive ground truth. Sets of whole seconds are rows
(source, second) beside a table of durations (source, duration_s)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

THRESHOLDS = (0.05, 0.1, 0.15, 0.2, 0.3)


def all_seconds(durations: DataFrame) -> DataFrame:
    return durations.filter("duration_s > 0").select("source", F.explode(F.sequence(F.lit(0), F.col("duration_s").cast("int") - 1)).alias("second"))


def clamped(seconds: DataFrame, durations: DataFrame) -> DataFrame:
    return seconds.join(durations, "source").filter("second >= 0 and second < duration_s").select("source", "second").distinct()


def energy(packets: DataFrame, durations: DataFrame, with_keyframes: bool = False) -> DataFrame:
    """Bytes of packets (pts_time, size, is_keyframe) in each second of each source; empty seconds are 0."""
    used = packets.filter("pts_time is not null") if with_keyframes else packets.filter("pts_time is not null and not is_keyframe")
    sums = used.filter("pts_time > -1").groupBy("source", F.col("pts_time").cast("int").alias("second")).agg(F.sum("size").cast("double").alias("energy"))
    return all_seconds(durations).join(sums, ["source", "second"], "left").select("source", "second", F.coalesce("energy", F.lit(0.0)).alias("energy"))


def over_threshold(curve: DataFrame, fraction: float | str) -> DataFrame:
    """Seconds with at least a fraction of their source's peak energy. fraction: a number or a column's name."""
    peak = F.max("energy").over(Window.partitionBy(*(c for c in curve.columns if c not in ("second", "energy"))))
    share = F.lit(fraction) if isinstance(fraction, float) else F.col(fraction)
    return curve.withColumn("peak_", peak).filter((F.col("energy") > 0) & (F.col("energy") >= share * F.col("peak_"))).drop("peak_", "energy")


def dilated(seconds: DataFrame, durations: DataFrame, pad_s: int, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["source"]
    near = F.sequence(F.greatest(F.lit(0), F.col("second") - pad_s), F.least(F.col("duration_s") - 1, F.col("second") + pad_s).cast("int"))
    return seconds.join(durations, "source").select(*keys, F.explode(near).alias("second")).distinct()


def presence(frames: DataFrame, least: int = 1) -> DataFrame:
    """Seconds with enough frames that hold a box. frames: source, frame_idx, fps, has_box."""
    hits = frames.filter("has_box").groupBy("source", F.floor(F.col("frame_idx") / F.col("fps")).cast("int").alias("second")).agg(F.count("*").alias("n"))
    return hits.filter(F.col("n") >= least).select("source", "second")


def frame_presence(detections: DataFrame, keys: list[str]) -> DataFrame:
    """For each frame: whether it holds a box, and the best confidence."""
    return detections.groupBy(*keys).agg(F.max(F.col("confidence").isNotNull()).alias("has_box"), F.coalesce(F.max("confidence"), F.lit(0.0)).alias("best_confidence"))


def scan_duration(frames, fps):
    """Whole seconds of so many frames, a started one counted."""
    return F.floor(frames / fps + 0.999999).cast("int")


def _ratios(counts: DataFrame) -> DataFrame:
    hits, truth, chosen, whole = (F.col(c) for c in ("hits", "true_seconds", "selected_seconds", "duration_s"))
    share = F.when(whole > 0, chosen / whole).otherwise(0.0)
    return counts.withColumns({
        "recall": F.when(truth > 0, hits / truth).otherwise(1.0),
        "precision": F.when(chosen > 0, hits / chosen).when(truth == 0, 1.0).otherwise(0.0),
        "selected_fraction": share, "compute_saved": 1.0 - share, "missed_seconds": truth - hits,
    })


def scores(selected: DataFrame, truth: DataFrame, durations: DataFrame, strategies: DataFrame, per: str = "source") -> DataFrame:
    """selected: strategy, source, second; truth: source, second; strategies: all of strategy. per: `source` scores each
    source, `total` all of them together (counts are summed, ratios never averaged)."""
    both = selected.withColumn("s_", F.lit(1)).join(truth.withColumn("t_", F.lit(1)), ["source", "second"], "left")
    chosen = both.groupBy("strategy", "source").agg(F.count("*").alias("selected_seconds"), F.count("t_").alias("hits"))
    real = truth.groupBy("source").agg(F.count("*").alias("true_seconds"))
    base = durations.join(real, "source", "left").join(F.broadcast(strategies), F.lit(True)).join(chosen, ["strategy", "source"], "left")
    counts = base.select("strategy", "source", "duration_s", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("true_seconds", "selected_seconds", "hits")))
    if per == "total":
        counts = counts.groupBy("strategy").agg(*(F.sum(c).alias(c) for c in ("duration_s", "true_seconds", "selected_seconds", "hits")))
    return _ratios(counts)


def bakeoff(packets: DataFrame, truth: DataFrame, durations: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, pad_s: int = 1) -> DataFrame:
    """All seconds, and one strategy for each threshold, for each source and (source null) for all together."""
    spark = packets.sparkSession
    grid = spark.createDataFrame([(f"motion>={t:g}", float(t)) for t in thresholds], "strategy string, fraction double")
    curve = energy(packets, durations).join(F.broadcast(grid), F.lit(True))
    chosen = dilated(over_threshold(curve, "fraction"), durations, pad_s, ["strategy", "source"])
    chosen = chosen.select("strategy", "source", "second").unionByName(all_seconds(durations).withColumn("strategy", F.lit("all")))
    names = grid.select("strategy").unionByName(spark.createDataFrame([("all",)], "strategy string"))
    each = scores(chosen, truth, durations, names)
    whole = each.groupBy("strategy").agg(*(F.sum(c).alias(c) for c in ("duration_s", "true_seconds", "selected_seconds", "hits")))
    return each.unionByName(_ratios(whole.withColumn("source", F.lit(None).cast(each.schema["source"].dataType))))
