"""Queries over poses: roles, angles, posture, guesses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes, posture
from ..functions.boxes import Box
from ..operators import poses
from . import views
from .registry import query, r6

D = views.DETECTIONS
#: Where a standing and a squatting subject's points are, as fractions of its box.
STAND = {"neck_base": (0.20, 0.42), "back_base": (0.28, 0.30), "back_middle": (0.50, 0.30), "back_end": (0.75, 0.33), "tail_end": (0.93, 0.20), "back_left_paw": (0.71, 0.96), "back_right_paw": (0.74, 0.96), "belly_bottom": (0.46, 0.66)}
SQUAT = {"neck_base": (0.22, 0.48), "back_base": (0.30, 0.40), "back_middle": (0.52, 0.24), "back_end": (0.70, 0.55), "tail_end": (0.86, 0.34), "back_left_paw": (0.66, 0.96), "back_right_paw": (0.69, 0.96), "belly_bottom": (0.48, 0.82)}
KEYS = ["cam", "slot", "blk"]
#: In which frames a point is unsure.
UNSURE = {"neck_base": 5, "tail_end": 4, "back_left_paw": 7, "back_middle": 11}


def pose_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.detections(spark, sf_dir).withColumn("blk", F.floor(F.col("frame_idx") / views.BLOCK).cast("int"))
    b, squat = Box.of(), F.col("blk") % 2 == 1
    entries = []
    for n in STAND:
        at = [F.when(squat, SQUAT[n][i]).otherwise(STAND[n][i]) for i in (0, 1)]
        sure = F.when(F.col("frame_idx") % UNSURE.get(n, 1 << 30) == (0 if n in UNSURE else -1), 0.2).otherwise(0.9)
        entries += [F.lit(n), F.struct((b.x1 + at[0] * (b.x2 - b.x1)).alias("x"), (b.y1 + at[1] * (b.y2 - b.y1)).alias("y"), sure.alias("confidence"))]
    return rows.withColumns({"points": F.create_map(*entries), "crop_bbox": b.struct()})


def point_sql(n: str) -> str:
    axis = lambda i, a, b: f"{a} + case when blk % 2 = 1 then {SQUAT[n][i]!r}::double else {STAND[n][i]!r}::double end * ({b} - {a})"
    sure = f"frame_idx % {UNSURE[n]} <> 0" if n in UNSURE else "true"
    short = {"neck_base": "n", "back_base": "w", "back_middle": "s", "back_end": "h", "tail_end": "t", "back_left_paw": "l", "back_right_paw": "r", "belly_bottom": "b"}[n]
    return f"case when {sure} then {axis(0, 'x1', 'x2')} end as {short}x, case when {sure} then {axis(1, 'y1', 'y2')} end as {short}y"


POINTS = f"(select *, {', '.join(map(point_sql, STAND))} from (select *, cast(floor(frame_idx / 60) as int) as blk from {D}))"


def line_sql(x: str, y: str) -> str:
    """The signed distance from the neck-spine line; the belly is always known."""
    return f"(case when ((sx-nx)*(\"by\"-ny) - (sy-ny)*(bx-nx)) < 0 then -1 else 1 end * ((sx-nx)*({y}-ny) - (sy-ny)*({x}-nx)) / sqrt((sx-nx)**2 + (sy-ny)**2))"


def angle_sql(ax: str, ay: str, bx: str, by: str) -> str:
    return f"case when ({ax})*({bx}) is not null then degrees(acos(greatest(-1, least(1, (({ax})*({bx}) + ({ay})*({by})) / (sqrt(({ax})**2 + ({ay})**2) * sqrt(({bx})**2 + ({by})**2)))))) end"


PAW_X, PAW_Y = "case when lx is null then rx else (lx+rx)/2 end", "case when ly is null then ry else (ly+ry)/2 end"
# hips also stand in for the tail's base, whose own point is not among these
FRAMES = f"""(select *, case when nx is null then sqrt((wx-hx)**2 + (wy-hy)**2) else (sqrt((nx-hx)**2 + (ny-hy)**2) + sqrt((wx-hx)**2 + (wy-hy)**2)) / 2 end as scale,
  (coalesce(nx, 0) + wx + coalesce(sx, 0) + hx) / (2 + (nx is not null)::int + (sx is not null)::int) as cx, (coalesce(ny, 0) + wy + coalesce(sy, 0) + hy) / (2 + (nx is not null)::int + (sx is not null)::int) as cy,
  2 + (nx is not null)::int + (sx is not null)::int as torso from {POINTS})"""
POSTURE = f"""(select *, {angle_sql('wx-sx', 'wy-sy', 'hx-sx', 'hy-sy')} as spine, {line_sql('hx', 'hy')} / scale as hip, ({line_sql(PAW_X, PAW_Y)} - {line_sql('hx', 'hy')}) / scale as hind,
  {angle_sql('hx-sx', 'hy-sy', 'tx-hx', 'ty-hy')} as tail, abs({line_sql('lx', 'ly')} - {line_sql('rx', 'ry')}) / scale as asym from {FRAMES} where torso >= 3)"""


@query(f"select cam, frame_idx, slot, torso, tx is not null as has_tail, round(hx, 6) as hips_x from {FRAMES}")
def l1_keypoint_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("points")
    return pose_rows(spark, sf_dir).select("cam", "frame_idx", "slot", posture.torso_count(p, 0.5).alias("torso"), posture.role(p, "tail_end", 0.5).isNotNull().alias("has_tail"), r6(posture.role(p, "tail_base", 0.5)["x"]).alias("hips_x"))


@query(f"select cam, frame_idx, slot, round({angle_sql('x1', 'y1', 'x2', 'y2')}, 6) as angle from {D}")
def l2_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Box.of()
    return views.detections(spark, sf_dir).select("cam", "frame_idx", "slot", r6(posture.angle_between((b.x1, b.y1), (b.x2, b.y2))).alias("angle"))


@query(f"select cam, frame_idx, slot, round({line_sql('hx', 'hy')}, 6) as distance from {POINTS}")
def l3_signed_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = {n: posture.role(F.col("points"), n, 0.5) for n in ("hips", "neck", "spine_mid", "belly")}
    return pose_rows(spark, sf_dir).select("cam", "frame_idx", "slot", r6(posture.signed_distance(r["hips"], r["neck"], r["spine_mid"], r["belly"])).alias("distance"))


@query(f"select cam, frame_idx, slot, round(scale, 6) as scale, 'torso' as quality from {FRAMES}")
def l4_body_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = posture.body_scale(F.col("points"), 0.5, F.col("crop_bbox"))
    return pose_rows(spark, sf_dir).select("cam", "frame_idx", "slot", s.alias("s")).select("cam", "frame_idx", "slot", r6("s.scale").alias("scale"), "s.quality")


@query(f"select cam, frame_idx, slot, round(cx, 6) as x, round(cy, 6) as y from {FRAMES}")
def l5_torso_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = posture.torso_centroid(F.col("points"), 0.5)
    return pose_rows(spark, sf_dir).select("cam", "frame_idx", "slot", c.alias("c")).select("cam", "frame_idx", "slot", r6("c.x").alias("x"), r6("c.y").alias("y"))


@query(f"select cam, frame_idx, slot, round(spine, 5) as spine_angle_deg, round(hip, 6) as hip_offset_ratio, round(hind, 6) as hind_paw_drop_ratio, round(tail, 5) as tail_angle_deg, round(asym, 6) as hind_paw_asymmetry from {POSTURE}")
def l6_frame_posture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = poses.frame_features(pose_rows(spark, sf_dir))
    return rows.select("cam", "frame_idx", "slot", *(F.round(f, 5 if f.endswith("deg") else 6).alias(f) for f in posture.FEATURES))


WINDOWS = f"""(with p as {POSTURE}, o as (select cam, slot, blk, arg_min(cx, frame_idx) as ox, arg_min(cy, frame_idx) as oy from p group by 1, 2, 3)
select cam, slot, blk, count(*) as n_frames_valid, max(mono_ts) - min(mono_ts) as dwell, quantile_cont(scale, 0.5) as scale, quantile_cont(spine, 0.5) as spine, quantile_cont(hip, 0.5) as hip, quantile_cont(tail, 0.5) as tail, quantile_cont(asym, 0.5) as asym,
  min(hip) as hip_min, max(hip) as hip_max, count(tail) as n_tail, max(sqrt((cx-ox)**2 + (cy-oy)**2)) / quantile_cont(scale, 0.5) as motion, count(*) >= 2 as moves from p join o using (cam, slot, blk) group by 1, 2, 3)"""


@query(f"select cam, slot, blk, n_frames_valid, round(dwell, 6) as dwell_duration_s, round(scale, 6) as body_scale_px, round(spine, 5) as spine_angle_deg, round(hip, 6) as hip_offset_ratio, round(tail, 5) as tail_angle_deg, round(hip_min, 6) as hip_offset_min, n_tail as tail_support, round(case when moves then motion end, 6) as centroid_motion_ratio, n_frames_valid < 3 as fallback from {WINDOWS}")
def g12_posture_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = poses.window_features(pose_rows(spark, sf_dir), KEYS, min_coverage=0.0)
    return f.select(*KEYS, "n_frames_valid", r6("dwell_duration_s").alias("dwell_duration_s"), r6("body_scale_px").alias("body_scale_px"), F.round("spine_angle_deg", 5).alias("spine_angle_deg"), r6("hip_offset_ratio").alias("hip_offset_ratio"), F.round("tail_angle_deg", 5).alias("tail_angle_deg"), r6("hip_offset_min").alias("hip_offset_min"), F.col("support")["tail_angle_deg"].alias("tail_support"), r6("centroid_motion_ratio").alias("centroid_motion_ratio"), "fallback")


BOXES = f"""(with b as (select cam, slot, cast(floor(frame_idx / 60) as int) as blk, count(*) as n, max(mono_ts) - min(mono_ts) as s, max(y2-y1) as hi, min(y2-y1) as lo, max((x2-x1)/(y2-y1)) as wi, min((x2-x1)/(y2-y1)) as sl from {D} group by 1, 2, 3),
d as (select *, greatest((hi-lo)/hi, (wi-sl)/sl) as depth from b)
select *, case when n < 2 then 'unknown' when s >= 5 and depth >= 0.08::double then 'poop' when s > 0 or depth > 0 then 'pee' else 'unknown' end as guess,
  case when n < 2 then 0 when s >= 5 and depth >= 0.08::double then least(0.65::double, 0.45::double + 0.15::double*depth + 0.02::double*s) when s > 0 or depth > 0 then least(0.6::double, 0.35::double + 0.1::double*depth + 0.01::double*s) else 0.2::double end as confidence from d)"""


def by_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.detections(spark, sf_dir).withColumn("blk", F.floor(F.col("frame_idx") / views.BLOCK).cast("int"))
    return poses.box_guess(rows, KEYS, deep=0.08)


@query(f"select cam, slot, blk, guess, round(confidence, 6) as confidence from {BOXES}")
def g13_box_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_boxes(spark, sf_dir).select(*KEYS, "guess", r6("confidence").alias("confidence"))


DECIDED = f"""(select *, (spine is not null)::int + (hip is not null)::int + (motion is not null and moves)::int + (tail is not null)::int as n,
  (coalesce(spine < 150, false)::int + coalesce(hip > 0.12::double, false)::int + coalesce(moves and motion < 0.6::double, false)::int + coalesce(tail >= 110, false)::int + (dwell >= 5)::int) as hits, coalesce(asym >= 0.25::double, false) as lift from {WINDOWS})"""
GUESS = "case when n < 2 or (spine is null and hip is null) then null when hits / (n + 1)::double >= 0.6::double and not lift then 'poop' else 'pee' end"


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poses.window_features(pose_rows(spark, sf_dir), KEYS, min_coverage=0.0)


@query(f"select cam, slot, blk, {GUESS} as guess, round(case when {GUESS} = 'poop' then least(0.65::double, 0.4::double + 0.25::double*hits/(n+1)::double) when {GUESS} = 'pee' then least(0.6::double, least(0.6::double, 0.35::double + 0.2::double*(1 - hits/(n+1)::double)) + case when lift then 0.1::double else 0 end) end, 6) as confidence from {DECIDED}")
def l7_posture_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = posture.decision(*(F.col(c) for c in ("spine_angle_deg", "hip_offset_ratio", "centroid_motion_ratio", "tail_angle_deg", "dwell_duration_s", "hind_paw_asymmetry")))
    return decided(spark, sf_dir).select(*KEYS, d.alias("d")).select(*KEYS, "d.guess", r6("d.confidence").alias("confidence"))


@query(f"select cam, slot, blk, coalesce(case when w.n_frames_valid >= 3 then {GUESS.replace('n <', 'w.n <').replace('(n +', '(w.n +')} end, b.guess) as guess, true as needs_label from {BOXES} b left join {DECIDED} w using (cam, slot, blk)")
def l10_guess_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poses.guesses(decided(spark, sf_dir), by_boxes(spark, sf_dir), KEYS).select(*KEYS, "guess", "needs_label")


@query()
def l8_posture_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pose_rows(spark, sf_dir)
    tried = rows.filter("frame_idx % 3 <> 1").withColumn("points", F.when(F.col("frame_idx") % 6 != 5, F.col("points")))
    return poses.gated(rows, tried, ["cam", "slot"], 2.0).select("cam", "slot", "frame_idx", "attempted", "usable", "squat", "still")


@query(f"select event_key, round(case when not known then case when near then 0.25::double else 0.5::double end when near then least(0.45::double, 0.25::double + 0.05::double * span) else least(0.7::double, 0.4::double + 0.03::double * dwell) end, 6) as confidence from (select event_key, event_key % 3 = 0 as near, event_key % 5 <> 0 as known, (event_key % 17)::double as dwell, (event_key % 7)::double as span from {views.EVENTS})")
def l9_event_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.dwell import event_confidence

    k = F.col("event_key")
    return views.events(spark, sf_dir).select("event_key", r6(event_confidence((k % 17).cast("double"), (k % 7).cast("double"), k % 3 == 0, k % 5 != 0)).alias("confidence"))


@query(f"""with b as (select * from (select *, cast(floor(frame_idx / 60) as int) as blk, row_number() over (partition by cam, frame_idx order by confidence desc, (x2-x1)*(y2-y1) desc, det_rank) as r from {D}) where r = 1),
f as (select cam, blk, list(frame_idx order by frame_idx) as f from b group by 1, 2) select cam, blk, unnest(case when len(f) <= 30 then f else list_transform(range(30), lambda i: f[floor(i * len(f) / 30::double)::int + 1]) end) as frame_idx from f""")
def l11_poses_to_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.detections(spark, sf_dir).withColumn("blk", F.floor(F.col("frame_idx") / views.BLOCK).cast("int"))
    return poses.poses_to_compute(rows, ["cam", "blk"], 30).select("cam", "blk", "frame_idx")


@query(f"select cam, frame_idx, slot, case when q % 9 = 0 then 'infer_none' when q % 9 = 1 then 'bad_shape' when q % 9 = 2 then 'no_finite_keypoints' else 'success' end as outcome, case when q % 9 > 2 then round(x1 + 1, 6) end as nose_x from {D}")
def l12_model_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("q") % 9
    bad = F.lit(float("nan"))
    good = F.array(F.array(F.array(F.lit(1.0), F.lit(2.0), F.lit(0.9)), F.array(bad, F.lit(2.0), F.lit(0.9))))
    nothing = F.array(F.array(F.array(bad, bad, bad), F.array(bad, bad, bad)))
    short = F.array(F.array(F.array(F.lit(1.0), F.lit(2.0), F.lit(0.9))))
    values = F.when(n == 1, short).when(n == 2, nothing).when(n > 2, good)
    found = posture.model_points(values, ["nose", "tail_end"], F.struct("x1", "y1"))
    return views.detections(spark, sf_dir).select("cam", "frame_idx", "slot", found.alias("m")).select("cam", "frame_idx", "slot", "m.outcome", r6(F.col("m.points")["nose"]["x"]).alias("nose_x"))


@query(f"select cam, frame_idx, slot, frame_idx % 3 <> 1 as attempted, frame_idx % 3 <> 1 and frame_idx % 6 <> 5 as posed from {D}")
def f12_pose_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pose_rows(spark, sf_dir)
    tried = rows.filter("frame_idx % 3 <> 1").withColumn("points", F.when(F.col("frame_idx") % 6 != 5, F.col("points")))
    found = poses.overlay_join(rows.select("cam", "frame_idx", "slot"), tried, ["cam", "frame_idx", "slot"])
    return found.select("cam", "frame_idx", "slot", "attempted", F.col("points").isNotNull().alias("posed"))
