"""Registered queries take whole tables: small tables against brute force."""

import bisect
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.types import StructType

from sightline.operators import ranks, tracking
from sightline.plans import catalog, views

QUERY = catalog.queries()


@pytest.fixture(scope="module")
def events_dir(spark, tmp_path_factory):
    """Events of one camera a minute apart, some a second before a chunk of 600 s ends."""
    at = datetime(2023, 11, 14, 22, 10)
    rows = [(k, 0, at + timedelta(seconds=600 * k - 1 if k % 3 else 600 * k + 60), "click", k * 12.5 + 0.0001) for k in range(1, 61)]
    path = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "event_id int, user_id int, ts timestamp, event_type string, value double").repartition(4).write.parquet(f"{path}/events.parquet")
    return path


def test_places_are_those_of_one_sort(spark):
    rows = [(i, i * 7919 % 101) for i in range(2000)]
    got = ranks.placed(spark.createDataFrame(rows, "i int, x int").repartition(7), "x", "i").collect()
    want = {i: n for n, (x, i) in enumerate(sorted((x, i) for i, x in rows), 1)}
    assert {r.i: r.place for r in got} == want and len(got) == 2000
    assert ranks.placed(spark.createDataFrame([], "i int"), "i").count() == 0


def test_numeric_order_places_every_event(spark, events_dir):
    def text(k):
        return f"a{k % 50}" if k % 9 == 0 else str(k % 300)

    order = sorted(range(1, 61), key=lambda k: (int(text(k)) if text(k).isdigit() else 0, text(k), k))
    got = QUERY["i4_numeric_order"](spark, events_dir).collect()
    assert sorted((r.place, r.event_key) for r in got) == list(enumerate(order, 1))


def test_chunk_repeats_of_every_event(spark, events_dir):
    """A span that reaches over its chunk's end by more than half of itself is found once, in the earlier chunk."""
    at, own, again = datetime(2023, 11, 14, 22, 10).timestamp(), [], []
    for e in spark.read.parquet(f"{events_dir}/events.parquet").collect():
        a = e.ts.timestamp()
        b, chunk = a + 4 + e.event_id % 5, a // 600 * 600
        own.append((chunk, e.event_id * 2, a, b))
        if b > chunk + 600:
            again.append((chunk + 600, e.event_id * 2 + 1, max(a, chunk + 598), b))
    kept = []
    for chunk, span, a, b in sorted(own + again):
        rivals = [(s, e) for c, _, s, e in kept if c < chunk and e > chunk and s < chunk + 10]
        shared = [max(0, min(b, e) - max(a, s)) / (max(b, e) - min(a, s)) for s, e in rivals]
        if not (b > chunk and a < chunk + 10 and any(x >= 0.5 for x in shared)):
            kept.append((chunk, span, a, b))
    assert at % 600 == 0 and any(x[1] // 2 % 2 for x in again) and len(kept) < len(own + again)
    assert sorted(r.span_id for r in QUERY["f7_chunk_repeats"](spark, events_dir).collect()) == sorted(x[1] for x in kept)


def test_lenient_numbers_of_every_event(spark, events_dir):
    """The parser sees numbers too, and gives back the value that the text was made of."""
    got = {r.event_key: r.number for r in QUERY["d9_lenient_values"](spark, events_dir).collect()}
    assert got == {k: k * 12.5 + 0.0001 if k % 4 == 1 else None for k in range(1, 61)}


@pytest.fixture(scope="module")
def lines_dir(spark, tmp_path_factory):
    """Four cameras, of which 0 and 3 have uneven frame times; both subjects in some frames only."""
    rows = [(k, n, float((k * 31 + n * 17) % 50 + 1)) for k in range(4000) if k % 1000 < 500 and k * 7 % 11 < 6 for n in range(1, 2 + k * 13 % 7)]
    path = str(tmp_path_factory.mktemp("lines"))
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double").repartition(4).write.parquet(f"{path}/lineitem.parquet")
    return path


def strided(start, end, stride, cap, times):
    """Frames start..end: every so many, or the first at or after each target time."""
    if times is None:
        found = list(range(start, end + 1, max(1, round(stride * 5.0))))
    else:
        found, target = [start], times[start] + stride
        while target <= times[end] + 1e-9:
            at = min(bisect.bisect_left(times, target), len(times) - 1)
            if start <= at <= end and at != found[-1]:
                found.append(at)
            target += stride
    return found if len(found) <= cap else sorted({found[round(i * (len(found) - 1) / (cap - 1))] for i in range(cap)})


def overlap(a, b):
    shared = max(0, min(a.x2, b.x2) - max(a.x1, b.x1)) * max(0, min(a.y2, b.y2) - max(a.y1, b.y1))
    size = lambda x: (x.x2 - x.x1) * (x.y2 - x.y1)
    return shared / (size(a) + size(b) - shared)


def test_sampling_of_every_clip(spark, lines_dir):
    clips = {c.clip: c for c in views.clips(spark, lines_dir).collect()}
    ranges = views.ranges(spark, lines_dir).collect()
    dets = views.detections(spark, lines_dir).collect()
    here, tracks = defaultdict(list), defaultdict(list)
    for d in sorted(dets, key=lambda d: (d.frame_idx, d.det_rank)):
        here[d.cam, d.frame_idx].append(d)
        tracks[d.cam, str(d.slot)].append(d)
    assert {c for c in clips if clips[c].frame_times_s} == {0, 3}

    want = {(r.clip, r.blk, f) for r in ranges for f in strided(r.start_frame, r.end_frame, 0.8, 6, clips[r.clip].frame_times_s)}
    got = [tuple(r) for r in QUERY["c8_stride_sampling"](spark, lines_dir).select("clip", "blk", "frame_idx").collect()]
    assert len(got) == len(want) and set(got) == want

    near, pick = {}, {}
    for r in ranges:
        for f in strided(r.start_frame, r.end_frame, 1.6, 10, clips[r.clip].frame_times_s) if r.behavior != "excluded" else []:
            known = tracks[r.clip, r.track_id] if r.track_id else []
            ref = min(known, key=lambda d: (abs(d.frame_idx - f), d.frame_idx), default=None)
            score = lambda d, ref=ref: overlap(d, ref) if ref else d.confidence
            best = max(here[r.clip, f], key=lambda d: (score(d), -d.det_rank), default=None)
            near[r.clip, r.blk, f] = (ref.x1, ref.y2) if ref else (None, None)
            pick[r.clip, r.blk, f] = best.x1 if best and (ref is None or score(best) >= 0.1) else None
    got = QUERY["f4_nearest_reference"](spark, lines_dir).collect()
    assert len(got) == len(near) and {(r.clip, r.blk, r.frame_idx): (r.x1, r.y2) for r in got} == near
    got = QUERY["f5_pick_detection"](spark, lines_dir).collect()
    assert len(got) == len(pick) and {(r.clip, r.blk, r.frame_idx): r.x1 for r in got} == pick
    assert all(r.matched == (r.x1 is not None) for r in got)
    matched = sum(x is not None for x in pick.values())
    assert sorted({r.clip for r in QUERY["a15_manifest"](spark, lines_dir).collect()}) == [0, 1, 2, 3]
    assert QUERY["a15_manifest"](spark, lines_dir).count() == matched
    stats = QUERY["g10_export_stats"](spark, lines_dir).first()
    assert (stats.ranges, stats.sampled, stats.written, stats.unmatched) == (len(ranges), len(pick), matched, len(pick) - matched)


def plain_tracks(dets, n, max_age):
    """(frame, det_rank) to track of one tracker over every frame of a camera."""
    tracker, out, by = tracking.Tracker(max_age=max_age), {}, defaultdict(list)
    for d in sorted(dets, key=lambda d: (d.frame_idx, d.det_rank)):
        by[d.frame_idx].append(d)
    for f in range(n):
        boxes = np.array([[d.x1, d.y1, d.x2, d.y2] for d in by[f]]).reshape(-1, 4)
        out |= {(f, d.det_rank): int(t) for d, t in zip(by[f], tracker.update(boxes, np.array([d.confidence for d in by[f]])), strict=True)}
    return out


def test_tracks_of_every_detection(spark, lines_dir):
    """Tracks die after frame 499 of each camera, and where blocks of frames jump; batches cut frames and bursts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.source, r.frame_idx, r.det_rank): int(r.track_id) for r in QUERY["k1_tracker"](spark, lines_dir).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    dets = views.detections(spark, lines_dir).collect()
    want = {(str(c), *k): t for c in range(4) for k, t in plain_tracks([d for d in dets if d.cam == c], 1000, 5).items()}
    assert got == want and any(120 <= f % 140 for _, f, _ in got) and max(got.values()) > 4


def test_a_burst_is_never_held_whole():
    """A camera that never empties: results come out while its rows are still being read."""
    names = ["source", "segment", "frame_idx", "det_rank", "x1", "y1", "x2", "y2", "confidence"]
    read = []

    def batches():
        for k in range(100):
            read.append(k)
            n = 1000
            yield pa.RecordBatch.from_arrays([pa.array(["c"] * n), pa.array([1] * n), pa.array(range(k * n, k * n + n)), pa.array([0] * n, pa.int32()), *(pa.array([float(x)] * n) for x in (0, 0, 9, 9, 1))], names=names)

    out = tracking._in_order(names, lambda: tracking.Tracking(tracking.Tracker), StructType.fromDDL(tracking.TRACKED))(batches())
    first = next(out)
    assert len(read) < 20 and set(first.column(4).to_pylist()) == {0, 1}
    assert first.num_rows + sum(b.num_rows for b in out) == 200_000


def test_segments_do_not_depend_on_stretches(spark):
    rng = np.random.default_rng(21)
    frames, boxes = [], []
    for source in "ab":
        idx = np.sort(rng.choice(400, 250, replace=False))
        frames += [(source, int(i)) for i in idx]
        boxes += [(source, int(i), 0.9) for i in idx if (i // 37) % 3 == 0 and rng.random() < 0.6]
    f, d = spark.createDataFrame(frames, "source string, frame_idx int"), spark.createDataFrame(boxes, "source string, frame_idx int, confidence double")
    seen = [sorted(map(tuple, tracking.segmented(f, d, 4, stretch=s).collect())) for s in (1 << 17, 64, 7, 1)]
    assert seen[0] and all(x == seen[0] for x in seen)
    want, has = [], set((s, i) for s, i, _ in boxes)
    for source in "ab":  # a plain loop
        gap, segment, order = 99, None, [i for s, i in frames if s == source]
        for n, i in enumerate(order, 1):
            if (source, i) in has:
                segment = n if gap > 4 + 1 - 1 and (segment is None or gap >= 5) else segment
                gap = 0
            else:
                gap += 1
            if segment is not None and gap <= 5:
                want.append((source, i, segment))
    assert seen[0] == sorted(want)


def test_one_iou_is_that_of_all_pairs():
    rng = np.random.default_rng(22)
    boxes = rng.integers(0, 20, (40, 4)).astype(float)
    every = tracking.overlaps(boxes, boxes)[0]
    assert all(tracking.iou(a, b) == every[i, j] for i, a in enumerate(boxes.tolist()) for j, b in enumerate(boxes.tolist()))


def test_frame_times_take_time_in_proportion(spark):
    """One clip of 12,000 frames: the normalised times are computed once, and not again for each of them."""
    import threading

    from pyspark.sql import functions as F

    from sightline.functions import timebase

    n = 12000
    times = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i / 5.0 + i % 7 / F.lit(100.0) + F.col("id"))
    spark.sparkContext.setJobGroup("frame times", "frame times", True)
    stop = threading.Timer(60, lambda: spark.sparkContext.cancelJobGroup("frame times"))
    stop.start()
    try:
        rows = spark.range(1, 2).select(times.alias("t")).select(timebase.normalised_times(F.col("t")).alias("fine"), timebase.uneven_times(F.col("t"), F.lit(5.0)).alias("uneven"), timebase.clip_times(F.col("t"), F.lit(10), F.lit(n - 1)).alias("part"))
        (row,) = rows.collect()
    finally:
        stop.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plain = [i / 5 + i % 7 / 100 + 1 for i in range(n)]
    assert row.fine == row.uneven == [pytest.approx(t - 1, abs=1e-9) for t in plain] and row.part == [pytest.approx(t - plain[10], abs=1e-9) for t in plain[10:]]
    odd = spark.createDataFrame([([],), (None,), ([2.0],), ([1.0, 1.2, 1.4],)], "t array<double>").select(timebase.normalised_times(F.col("t")).alias("fine"), timebase.uneven_times(F.col("t"), F.lit(5.0)).alias("uneven"), timebase.clip_times(F.col("t"), F.lit(1), F.lit(2)).alias("part"))
    assert [tuple(r) for r in odd.collect()] == [([], None, None), (None, None, None), ([0.0], None, None), ([0.0, 0.2, 0.4], None, [0.0, 0.2])]
    for bad in ([0.0, float("nan")], [0.0, 1.0, 0.5], [0.0, None]):
        with pytest.raises(Exception, match="finite"):
            spark.createDataFrame([(bad,)], "t array<double>").select(timebase.normalised_times(F.col("t"))).collect()
