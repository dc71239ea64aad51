"""Zones by slabs against every edge tested."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from sightline.functions import boxes
from sightline.functions.boxes import Box
from sightline.operators import gates

ZONE = "array<array<struct<x:double,y:double>>>"
CAMERAS = f"camera_id string, detection_conf_threshold double, roi {ZONE}, ignore_zones {ZONE}"


def star(n: int, r: random.Random, x: float, y: float, far: float, spiky: float) -> list[tuple[float, float]]:
    return [(x + far * (1 - spiky * r.random()) * math.cos(2 * math.pi * k / n), y + far * (1 - spiky * r.random()) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def plain(detections, cameras):
    """Every zone's every edge, as a column."""
    joined = detections.join(cameras, "camera_id")
    x, y = boxes.center(Box.of())
    fine = (F.col("confidence") >= F.col("detection_conf_threshold")) & gates.allowed(x, y, F.col("roi"), F.col("ignore_zones"), F.col("width"), F.col("height"))
    return joined.filter(fine).select(*detections.columns)


def test_gate_by_slabs_is_the_gate(spark):
    r = random.Random(1)
    square = [(0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75)]
    cameras = [
        ("large", 0.3, [star(600, r, 0.5, 0.5, 0.45, 0.0)], [star(40, r, 0.5, 0.5, 0.2, 0.8)]),
        ("spiky", 0.3, [star(300, r, 0.3, 0.5, 0.3, 0.9), star(30, r, 0.8, 0.5, 0.3, 0.5)], []),
        ("edges", 0.3, [square], [[(0.5, 0.5), (0.5, 0.5), (0.5, 0.5)]]),
        ("outside", 0.3, [[(-5.0, -5.0), (9.0, -5.0), (2.0, 12.0)]], [square, [(0.0, 0.0), (1.0, 1.0)]]),
        ("small", 0.3, [[(0.1, 0.1), (0.9, 0.9)]], []),
        ("none", 0.3, [], []), ("null", 0.3, None, None),
    ]
    rows = []
    for camera, *_ in cameras:
        for k in range(150):
            x, y = r.random(), r.random()
            if k % 3 == 0:  # on edges, at corners and at their heights
                x, y = r.choice([0.25, 0.75, 0.5, r.random()]), r.choice([0.25, 0.75, 0.5])
            size = {0: (1000, 1000), 1: (None, 1000), 2: (0, 1000)}[1 if k == 7 else 2 if k == 8 else 0]
            rows.append((camera, k, 1000 * x - 2, 1000 * y - 2, 1000 * x + 2, 1000 * y + 2, r.choice([0.2, 0.3, 0.9]), *size, "clash"))
    detections = spark.createDataFrame(rows, "camera_id string, n int, x1 double, y1 double, x2 double, y2 double, confidence double, width int, height int, slab_note string")
    frame = spark.createDataFrame(cameras, CAMERAS)
    take = lambda d: sorted((x.camera_id, x.n) for x in d.collect())
    got = take(gates.gate(detections, frame))
    assert got == take(plain(detections, frame)) and 100 < len(got) < 700


def test_a_point_meets_few_of_ten_thousand_edges(spark):
    r = random.Random(2)
    cameras = spark.createDataFrame([("a", 0.0, [star(10_000, r, 0.5, 0.5, 0.45, 0.0)], [])], CAMERAS)
    known, edges = gates.zone_index(cameras, "camera_id")
    sizes = edges.select(F.size("edges_").alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert known.first()["slabs_"] > 1000 and sizes[1] < 50_000 and sizes[0] < 400
    rows = [("a", k, (x := 1000 * r.random()), (y := 1000 * r.random()), x, y, 0.5, 1000, 1000) for k in range(300)]
    detections = spark.createDataFrame(rows, "camera_id string, n int, x1 double, y1 double, x2 double, y2 double, confidence double, width int, height int")
    near = lambda x, y: (x / 1000 - 0.5) ** 2 + (y / 1000 - 0.5) ** 2 < 0.45**2
    assert sorted(x.n for x in gates.gate(detections, cameras).collect()) == [row[1] for row in rows if near(row[2], row[3])]
