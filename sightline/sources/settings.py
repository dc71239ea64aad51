"""Camera settings as a dimension table, with range checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
CAMERAS = (
    "camera_id string, name string, enabled boolean, detection_conf_threshold double, event_duration_s double, stationary_threshold_s double, dwell_trigger_s double, sample_rate_fps double, "
    f"pre_roll_s double, post_roll_s double, retention_days int, retention_max_gb double, roi array<array<{POINT}>>, ignore_zones array<array<{POINT}>>"
)
#: Product defaults and the least value of each setting.
DEFAULTS = {"enabled": True, "detection_conf_threshold": 0.25, "event_duration_s": 2.0, "stationary_threshold_s": 2.0, "dwell_trigger_s": 5.0, "sample_rate_fps": 5.0, "pre_roll_s": 10.0, "post_roll_s": 30.0, "retention_days": 30}
POSITIVE = ("event_duration_s", "stationary_threshold_s", "dwell_trigger_s", "sample_rate_fps", "retention_max_gb")
NOT_NEGATIVE = ("pre_roll_s", "post_roll_s", "retention_days")


def with_defaults(cameras: DataFrame) -> DataFrame:
    return cameras.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items() if c in cameras.columns})


def checked_cameras(cameras: DataFrame) -> DataFrame:
    """cameras with problem: the first setting out of range, or null."""
    outside = lambda zones: F.exists(zones, lambda z: F.exists(z, lambda p: (p["x"] < 0) | (p["x"] > 1) | (p["y"] < 0) | (p["y"] > 1)))
    tests = [(c, F.col(c) <= 0) for c in POSITIVE] + [(c, F.col(c) < 0) for c in NOT_NEGATIVE]
    tests += [("detection_conf_threshold", (F.col("detection_conf_threshold") < 0) | (F.col("detection_conf_threshold") > 1))] + [(c, outside(F.col(c))) for c in ("roi", "ignore_zones")]
    tests = [t for t in tests if t[0] in cameras.columns]
    return cameras.withColumn("problem", F.coalesce(*(F.when(bad, c) for c, bad in tests)))


def strict_cameras(cameras: DataFrame) -> DataFrame:
    """Fails on the first camera with a problem."""
    rows = checked_cameras(cameras)
    sure = F.assert_true(F.col("problem").isNull(), F.concat(F.lit("bad camera setting: "), F.coalesce("problem", F.lit(""))))
    return rows.withColumn("ok_", sure).filter("ok_ is null").drop("ok_", "problem")
