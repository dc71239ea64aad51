"""Posture features of batches against the column functions, and the trailing gate against windows cut one by one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sightline.functions import posture
from sightline.operators import poses
from sightline.plans import catalog, pose_queries

NAMES = sorted({c for r in posture.ROLES.values() for c in r} | set(posture.TORSO) | {"left_eye"})
POSES = "n int, mono_ts double, points map<string,struct<x:double,y:double,confidence:double>>, crop_bbox struct<x1:double,y1:double,x2:double,y2:double>, scale_note string"


def some_poses(spark):
    r = random.Random(5)
    rows = []
    for n in range(300):
        points = {c: (r.randint(0, 9) * 10.0, r.randint(0, 9) * 10.0, r.choice([0.2, 0.5, 0.9])) for c in NAMES if r.random() < 0.85}
        if n % 50 == 0:
            points = {c: (5.0, 5.0, 0.9) for c in NAMES}  # all at one place
        crop = None if n % 7 == 0 else (0.0, 0.0, 30.0 * (n % 3), 40.0 * (n % 3))
        rows.append((n, n / 5, None if n % 31 == 0 else {} if n % 37 == 0 else points, crop, "clash"))
    return spark.createDataFrame(rows, POSES)


def test_batch_features_are_the_columns(spark):
    p, c = F.col("points"), 0.5
    role = lambda n: posture.role(p, n, c)
    scale = posture.body_scale(p, c, F.col("crop_bbox"))
    line = lambda q: posture.signed_distance(q, role("neck"), role("spine_mid"), role("belly"))
    left, right = role("hind_left_paw"), role("hind_right_paw")
    columns = {
        "scale": scale["scale"], "quality": scale["quality"],
        "spine_angle_deg": posture.angle_at(role("withers"), role("spine_mid"), role("hips")),
        "hip_offset_ratio": line(role("hips")) / scale["scale"],
        "hind_paw_asymmetry": F.abs(line(left) - line(right)) / scale["scale"],
        "centroid": posture.torso_centroid(p, c),
    }
    wanted = some_poses(spark).filter(posture.torso_count(p, c) >= 3).select("n", *(x.alias(n) for n, x in columns.items())).collect()
    found = {r.n: r for r in poses.frame_features(some_poses(spark)).collect()}
    assert len(found) == len(wanted) > 150
    for w in wanted:
        got = found[w.n]
        assert (got.quality, got.scale_note) == (w.quality, "clash")
        for name in columns:
            a, b = got[name], w[name]
            if w.scale is None and name not in ("quality", "scale"):
                assert a is None
            elif name == "centroid":
                assert tuple(a) == pytest.approx(tuple(b))
            elif name != "quality":
                assert (a is None and b is None) or a == pytest.approx(b), (w.n, name)


def test_gate_looks_at_the_trailing_window(spark):
    """A few boxes' windows, cut by hand."""
    small = "/root/testdata/sf0.001"
    told = {(r.cam, r.slot, r.frame_idx): r for r in catalog.queries()["l8_posture_gate"](spark, small).collect()}
    assert told
    rows = pose_queries.pose_rows(spark, small).select("cam", "slot", "frame_idx", "mono_ts", "points", "crop_bbox").cache()
    width = 2.0
    boxes = sorted({(r.cam, r.slot, r.frame_idx, r.mono_ts) for r in rows.select("cam", "slot", "frame_idx", "mono_ts").collect()})[10:400:29]
    # Not every box has a pose, and not every pose came to something.
    tried = rows.filter("frame_idx % 3 <> 1").withColumn("points", F.when(F.col("frame_idx") % 6 != 5, F.col("points")))
    counts, windows = {}, None
    for cam, slot, frame, at in boxes:
        near = tried.filter((F.col("cam") == cam) & (F.col("slot") == slot) & (F.col("mono_ts") <= at) & (F.col("mono_ts") >= at - width)).withColumn("at_frame", F.lit(frame))
        counts[cam, slot, frame] = tuple(near.agg(F.count("*"), F.count("points")).first())
        near = near.filter("points is not null")
        windows = near if windows is None else windows.unionByName(near)
    made = {(r.cam, r.slot, r.at_frame): r for r in poses.window_features(windows, ["cam", "slot", "at_frame"]).collect()}
    for cam, slot, frame, _ in boxes:
        window, row = made.get((cam, slot, frame)), told.get((cam, slot, frame))
        attempted, usable = counts[cam, slot, frame]
        if window is None or window.fallback or usable < 3 or usable < attempted / 2:
            assert row is None
            continue
        squat = (window.spine_angle_deg is not None and window.spine_angle_deg < 150.0) or (window.hip_offset_ratio is not None and window.hip_offset_ratio > 0.12)
        assert row is not None and row.squat == squat and (row.attempted, row.usable) == (attempted, usable)
        assert row.still == (None if window.centroid_motion_ratio is None else window.centroid_motion_ratio < 0.6)
