"""Tracker, dwell machine and spans: case tables, and batch against a plain unsegmented replay."""

import numpy as np
import pytest

from sightline.operators import dwell, spans, tracking
from sightline.operators.dwell import Machine, Posture, Settings
from sightline.streaming.sightings import Live

DETECTIONS = "source string, frame_idx int, mono_ts double, det_rank int, x1 double, y1 double, x2 double, y2 double, confidence double"


def table(spark, boxes, fps=1.0, frames=None, source="cam"):
    """boxes: frame to list of (x1, y1, x2, y2)."""
    n = frames or max(boxes) + 1
    rows = [(source, f, f / fps, r, *map(float, b), 0.9 - r / 100) for f, bs in boxes.items() for r, b in enumerate(bs)]
    return spark.createDataFrame([(source, f, f / fps) for f in range(n)], "source string, frame_idx int, mono_ts double"), spark.createDataFrame(rows, DETECTIONS)


def standing(x):
    return (x, 20, x + 40, 100)


def ids(boxes, **how):
    tracker = tracking.Tracker(**how)
    return [tracker.update(np.array(b, float).reshape(-1, 4), np.full(len(b), 0.9)).tolist() for b in boxes]


def test_overlaps():
    iou, _ = tracking.overlaps(np.array([[0, 0, 10, 10.0]]), np.array([[5, 5, 15, 15.0], [20, 20, 30, 30], [3, 3, 3, 9]]))
    assert iou[0] == pytest.approx([1 / 7, 0, 0])


def test_ageing():
    det = [(0, 0, 10, 10)]
    assert ids([det, [], det], max_age=1) == [[1], [], [1]]
    assert ids([det, [], [], det], max_age=1) == [[1], [], [], [2]]


def test_center_gate():
    moves = [[(0, 0, 20, 20)], [(25, 0, 45, 20)]]
    assert ids(moves, center_gate=1.5) == [[1], [1]]
    assert ids(moves, center_gate=0.5) == ids(moves) == [[1], [2]]


def test_hold_walk_and_two_subjects(spark):
    settings = Settings(1.0, 5.0, 2.0)
    hold = dwell.dwell_events(*table(spark, {f: [standing(40)] for f in range(8)}), settings).collect()
    assert len(hold) == 1 and hold[0].primary_track_id == "1" and hold[0].start_mono == 0 and hold[0].dwell_duration_s >= 5
    assert dwell.dwell_events(*table(spark, {f: [standing(35 * f)] for f in range(5)}), settings).count() == 0
    two = dwell.dwell_events(*table(spark, {f: [standing(25), standing(95)] for f in range(8)}), settings).collect()
    assert len(two) == 1 and two[0].multi and two[0].ambiguous and two[0].track_ids == ["1", "2"]


def test_cooldown_then_again(spark):
    found = dwell.dwell_events(*table(spark, {f: [standing(40)] for f in range(8)}), Settings(1.0, 2.0, 1.0)).orderBy("start_mono").collect()
    assert [e.primary_track_id for e in found] == ["1", "1"]


def random_boxes(rng, n=160):
    at, out = rng.uniform(0, 300, (3, 2)), {}
    for f in range(n):
        if rng.random() < 0.03:
            at = rng.uniform(0, 300, (3, 2))
        if (f // 23) % 3 == 2:
            continue
        here = [tuple(p + rng.normal(0, 1, 2)) for p in at if rng.random() < 0.8]
        out[f] = [(x, y, x + 40, y + 30) for x, y in here]
    return {f: b for f, b in out.items() if b}


def replay(boxes, n, fps, settings, max_age):
    live, out = Live(settings, fps, max_age), []
    for f in range(n):
        b = np.array(boxes.get(f, []), float).reshape(-1, 4)
        out += live.frame(f, f / fps, b, 0.9 - np.arange(len(b)) / 100)
    return out + live.machine.flush()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_segments_change_nothing(spark, seed):
    boxes = random_boxes(np.random.default_rng(seed))
    settings = Settings(1.0, 2.0, 1.0, near_misses=True)
    frames, dets = table(spark, boxes, 5.0, 160)
    got = dwell.dwell_events(frames.repartition(3), dets.repartition(5), settings, 5.0, 4).orderBy("end_frame", "near_miss").collect()
    want = sorted(replay(boxes, 160, 5.0, settings, 4), key=lambda e: (e["end_frame"], e["near_miss"]))
    assert [(e.start_frame, e.end_frame, e.near_miss, e.n_detections, e.multi) for e in got] == [(e["start_frame"], e["end_frame"], e["near_miss"], e["n_detections"], e["multi"]) for e in want]
    assert [e.dwell_duration_s for e in got] == pytest.approx([e["dwell_duration_s"] for e in want])


def test_machine_suppresses_all_tracks_of_an_event():
    machine, box = Machine(Settings(1.0, 1.0, 0.0)), np.zeros((1, 4))
    emitted = [len(machine.frame(t, n, box, [Posture("1", 1.0, 0.0, t - 1, True)], 1)) for n, t in enumerate((1.0, 1.5, 2.0))]
    assert emitted == [1, 0, 1]  # the cooldown is the longest of the three settings: a second


def test_spans_merge_pad_and_split(spark):
    rows = [("1", i, i / 10.0) for i in (0, 5, 10, 60, 65)] + [("2", 30, 3.0)]
    samples = spark.createDataFrame(rows, "track_id string, frame_idx int, time_s double")
    got = spans.spans(samples, ["track_id"], 10.0, 100).orderBy("track_id", "start_frame").collect()
    assert [(r.track_id, r.start_frame, r.end_frame, r.n_samples) for r in got] == [("1", 0, 20, 3), ("1", 50, 75, 2), ("2", 20, 40, 1)]
    cut = spans.spans(samples, ["track_id"], 10.0, 100, merge_gap_s=10.0, max_len_s=4.0).filter("track_id = '1'").orderBy("part").collect()
    assert [(r.start_s, r.end_s) for r in cut] == [(0.0, 4.0), (4.0, 7.5)]


def test_chunk_repeats(spark):
    rows = [("c", 0.0, "prev-overlap", 3600.0, 3604.0), ("c", 0.0, "prev-earlier", 30.0, 34.0), ("c", 3600.0, "current-overlap", 0.0, 4.0), ("c", 3600.0, "current-later", 30.0, 34.0), ("d", 0.0, "twin-1", 1.0, 3.0), ("d", 0.0, "twin-2", 1.0, 3.0)]
    found = spans.without_chunk_repeats(spark.createDataFrame(rows, "camera_id string, chunk_start_s double, span_id string, start_s double, end_s double"), ["camera_id"], 10.0, 3600.0)
    assert sorted(r.span_id for r in found.collect()) == ["current-later", "prev-earlier", "prev-overlap", "twin-1", "twin-2"]
