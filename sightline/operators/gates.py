"""Which detections count: zones, confidence, classes, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.boxes import Box
from ..lineage import settled

SUBJECT_BOOST = 0.05


def allowed(x: Column, y: Column, roi: Column, ignored: Column, frame_width: Column, frame_height: Column) -> Column:
    """A pixel inside any region of interest, if there are any, and in no ignored zone. Zones (arrays of arrays of
    struct<x, y> in 0..1) of fewer than three points don't count; zones with an unknown frame size let nothing pass."""
    real = lambda zones: F.filter(F.coalesce(zones, F.array()), lambda z: F.size(z) >= 3)
    u, v = x / frame_width, y / frame_height
    inside = lambda zones: F.exists(zones, lambda z: boxes.in_polygon(u, v, z))
    roi, ignored = real(roi), real(ignored)
    none = (F.size(roi) == 0) & (F.size(ignored) == 0)
    known = F.coalesce((frame_width > 0) & (frame_height > 0), F.lit(False))
    return none | (known & ((F.size(roi) == 0) | inside(roi)) & ~inside(ignored))


#: How far beyond an edge's ends a point can still be on it, in parts of a frame (from boxes.EPSILON, rounded up), and the
#: most slabs of a camera.
REACH, SLABS = 1e-4, 1 << 20


def zone_edges(cameras: DataFrame, key: str) -> DataFrame:
    """key, zone (from 0, those of interest first), ignored, ax..by: the edges of zones of three points or more."""

    def marked(zones: str, ignored: bool) -> Column:
        return F.transform(F.coalesce(zones, F.array()), lambda z: F.struct(z.alias("z"), F.lit(ignored).alias("ignored")))

    both = F.concat(marked("roi", False), marked("ignore_zones", True))
    zones = cameras.select(key, F.posexplode(both).alias("zone", "one_")).select(key, "zone", "one_.ignored", F.col("one_.z").alias("z_")).filter(F.size("z_") >= 3)
    before = F.concat(F.slice("z_", -1, 1), F.slice("z_", 1, F.size("z_") - 1))
    pairs = F.zip_with(before, F.col("z_"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    edges = zones.select(key, "zone", "ignored", F.explode(pairs).alias("e_"))
    return edges.select(key, "zone", "ignored", F.col("e_.a.x").alias("ax"), F.col("e_.a.y").alias("ay"), F.col("e_.b.x").alias("bx"), F.col("e_.b.y").alias("by"))


def zone_index(cameras: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Zones by slabs of height. (key, slabs_, n_roi_, n_ignored_) for each camera, and (key, slab_, edges_): the edges
    that a point in a slab can meet. A camera has as many slabs as leave an edge in four of them on average, so a
    point meets few more edges than a line through the frame at its height crosses."""
    edges = zone_edges(cameras, key)
    sizes = edges.groupBy(key).agg(
        F.count("*").alias("n_"), F.sum(F.abs(F.col("ay") - F.col("by")) + 2 * REACH).alias("high_"),
        F.count_distinct(F.when(~F.col("ignored"), F.col("zone"))).alias("n_roi_"), F.count_distinct(F.when(F.col("ignored"), F.col("zone"))).alias("n_ignored_"),
    )
    slabs = F.floor(F.greatest(F.lit(1.0), F.least(F.lit(float(SLABS)), 3 * F.col("n_") / F.col("high_")))).cast("long")
    sizes = sizes.select(key, slabs.alias("slabs_"), "n_roi_", "n_ignored_")
    known = cameras.select(key).join(sizes, key, "left").fillna({"slabs_": 1, "n_roi_": 0, "n_ignored_": 0})
    at = lambda y: F.floor(y * F.col("slabs_"))
    dealt = edges.join(sizes, key).withColumn("slab_", F.explode(F.sequence(at(F.least("ay", "by") - REACH), at(F.greatest("ay", "by") + REACH))))
    edge = F.struct("zone", "ignored", "ax", "ay", "bx", "by")
    return known, dealt.groupBy(key, "slab_").agg(F.sort_array(F.collect_list(edge)).alias("edges_"))


def _within(x: Column, y: Column, edges: Column, ignored: bool) -> Column:
    """Whether a point is in any zone of a kind. Edges come zone by zone, so one pass counts crossings of each."""
    mine = F.filter(edges, lambda e: e["ignored"] == F.lit(ignored))
    start = F.struct(F.lit(-1).alias("zone"), F.lit(False).alias("odd"), F.lit(False).alias("found"))

    def step(acc: Column, e: Column) -> Column:
        a, b = (F.struct(e[p + "x"].alias("x"), e[p + "y"].alias("y")) for p in "ab")
        new = acc["zone"] != e["zone"]
        odd = (~new & acc["odd"]) != boxes.crosses(x, y, a, b)
        return F.struct(e["zone"].alias("zone"), odd.alias("odd"), (acc["found"] | (new & acc["odd"]) | boxes.on_edge(x, y, a, b)).alias("found"))

    return F.coalesce(F.aggregate(mine, start, step, lambda acc: acc["found"] | acc["odd"]), F.lit(False))


def gate(detections: DataFrame, cameras: DataFrame, key: str = "camera_id") -> DataFrame:
    """Detections (x1..y2, confidence, width, height) that their camera's threshold and zones let pass, by the rules of
    allowed. cameras: one row for each camera (detection_conf_threshold, roi, ignore_zones). A detection meets only the
    edges of its slab."""
    cameras = settled(cameras.select(key, "detection_conf_threshold", "roi", "ignore_zones"))  # a row a camera, read often
    known, edges = (settled(d) for d in zone_index(cameras, key))
    known = cameras.select(F.col(key), F.col("detection_conf_threshold").alias("t_")).join(known, key)
    x, y = boxes.center(Box.of())
    u, v = x / F.col("width"), y / F.col("height")
    sized = F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False))
    rows = detections.join(known, key).filter(F.col("confidence") >= F.col("t_"))
    rows = rows.withColumn("slab_", F.when(sized, F.floor(v * F.col("slabs_")))).join(edges, [key, "slab_"], "left")
    none = (F.col("n_roi_") == 0) & (F.col("n_ignored_") == 0)
    inside = (F.col("n_roi_") == 0) | _within(u, v, F.col("edges_"), False)
    return rows.filter(none | (sized & inside & ~_within(u, v, F.col("edges_"), True))).select(*detections.columns)


def split_by_threshold(detections: DataFrame, threshold: float | Column) -> DataFrame:
    return detections.withColumn("kept", F.col("confidence") >= threshold)


def suppressed(detections: DataFrame, keys: list[str], iou_threshold: float, subject: str = "dog", order: str = "det_rank") -> DataFrame:
    """Class-agnostic suppression within each frame: greedy by confidence (the subject's a little raised); a box that
    overlaps a kept one by more than iou_threshold is dropped. A frame's few boxes are folded as one array."""
    fields = [c for c in detections.columns if c not in keys]
    lift = F.col("confidence") + F.when(F.lower("class_name") == subject, SUBJECT_BOOST).otherwise(0.0)
    item = F.struct((-lift).alias("p_"), F.col(order).alias("o_"), F.struct(*fields).alias("d_"))
    frames = detections.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items_"))
    kind = F.expr(f"filter(array(element_at(items_, 1)), x -> false)")
    kept = F.aggregate("items_", kind, lambda acc, x: F.when(F.exists(acc, lambda k: boxes.iou(Box.of(k["d_"]), Box.of(x["d_"])) > iou_threshold), acc).otherwise(F.concat(acc, F.array(x))))
    return frames.select(*keys, F.inline(F.transform(kept, lambda x: x["d_"]))).select(*detections.columns)


def accepted(detections: DataFrame, keys: list[str], aliases: list[str], threshold: float, frame_width: Column, frame_height: Column, iou_threshold: float = 0.6, subject: str = "dog", order: str = "det_rank") -> DataFrame:
    """Boxes of the subject or an alias at or over the threshold, clipped to the frame; suppression only if there are
    aliases. det_rank is renewed by confidence."""
    names = [subject, *dict.fromkeys(a.strip().lower() for a in aliases if a.strip() and a.strip().lower() != subject)]
    found = detections.filter(F.lower("class_name").isin(names) & (F.col("confidence") >= threshold))
    found = found.withColumns(dict(zip(Box._fields, boxes.clipped(Box.of(), frame_width, frame_height), strict=True)))
    if len(names) > 1:
        found = suppressed(found, keys, iou_threshold, subject, order)
    rank = Window.partitionBy(*keys).orderBy(F.col("confidence").desc(), order)
    return found.withColumn(order, F.row_number().over(rank) - 1)


def top_objects(detections: DataFrame, keys: list[str], floor: float, n: int, order: str = "det_rank") -> DataFrame:
    rank = Window.partitionBy(*keys).orderBy(F.col("confidence").desc(), order)
    return detections.filter(F.col("confidence") >= floor).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= n)


def ambiguous_frames(detections: DataFrame, keys: list[str], track: str = "track_id", least_iou: float = 0.2) -> DataFrame:
    """For each frame: tracks, whether several are there, and whether that or overlapping boxes make it ambiguous."""
    box = F.struct(*Box._fields)
    frames = detections.groupBy(*keys).agg(F.count_distinct(track).alias("n_tracks"), F.collect_list(box).alias("b_"))
    meet = F.exists(F.sequence(F.lit(0), F.size("b_") - 1), lambda i: F.exists(F.slice("b_", i + 2, F.size("b_")), lambda o: boxes.iou(Box.of(F.get("b_", i)), Box.of(o)) >= least_iou))
    return frames.select(*keys, "n_tracks", (F.col("n_tracks") > 1).alias("multi"), ((F.col("n_tracks") > 1) | meet).alias("ambiguous"))


def best_per_frame(detections: DataFrame, keys: list[str], order: str = "det_rank") -> DataFrame:
    """The surest box of each frame, then the largest, then the first."""
    rank = Window.partitionBy(*keys).orderBy(F.col("confidence").desc(), boxes.area(Box.of()).desc(), order)
    return detections.withColumn("r_", F.row_number().over(rank)).filter("r_ = 1").drop("r_")
