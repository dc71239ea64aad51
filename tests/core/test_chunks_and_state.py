"""Bursts folded in chunks, suppression, and streams with state in parts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import chunked, dwell, tracking
from sightline.plans import catalog
from sightline.plans.track_queries import sources
from sightline.streaming import release

SMALL = "/root/testdata/sf0.001"


def busy(spark, n: int, seed: int = 1):
    """A camera that never empties: subjects that rest, walk, cross and rest on each other exactly."""
    r = random.Random(seed)
    rows, at = [], [[100.0, 100.0], [400.0, 100.0], [700.0, 300.0]]
    for frame in range(n):
        for k, place in enumerate(at):
            if frame // 90 % 3 == k:
                place[0] += 3.0 * r.choice([-1, 1, 1])
            if frame % 400 == 399 and k == 1:
                at[1] = list(at[0])  # two boxes at one place
            if frame % 400 == 60 and k == 1:
                at[1] = [400.0 + r.randint(0, 50), 100.0]
            if k == 2 and frame % 700 > 640:
                continue
            rows.append(("cam", frame, frame / 5, k, place[0], place[1], place[0] + 80, place[1] + 60, [0.9, 0.8, 0.7][k]))
    found = spark.createDataFrame(rows, "source string, frame_idx long, mono_ts double, det_rank int, x1 double, y1 double, x2 double, y2 double, confidence double")
    return spark.range(n).select(F.lit("cam").alias("source"), F.col("id").alias("frame_idx"), (F.col("id") / 5).alias("mono_ts")), found


def ids(frame) -> list:
    return sorted((r.frame_idx, r.det_rank, r.track_id) for r in frame.select("frame_idx", "det_rank", "track_id").collect())


@pytest.mark.parametrize(("chunk", "rounds"), [(250, 4), (101, 0)])
def test_a_camera_that_never_empties(spark, monkeypatch, chunk, rounds):
    """Chunks in many tasks give the rows of one fold, however many begin otherwise than guessed."""
    frames, found = busy(spark, 1500)
    settings = dwell.Settings(1.0, 3.0, 1.0)
    whole = ids(tracking.tracked(frames, found, max_age=5, chunk=1 << 20)[0])
    events = [r for r in dwell.dwell_events(frames, found, settings, 5.0, 5, chunk=1 << 20).orderBy("end_frame").collect()]
    assert len(whole) == found.count() and len(events) > 10
    monkeypatch.setattr(chunked, "ROUNDS", rounds)
    assert ids(tracking.tracked(frames, found, max_age=5, chunk=chunk)[0]) == whole
    assert dwell.dwell_events(frames, found, settings, 5.0, 5, chunk=chunk).orderBy("end_frame").collect() == events


def test_chunks_match_a_plain_loop(spark):
    frames, found = busy(spark, 900, 2)
    by = {}
    for r in found.orderBy("frame_idx", "det_rank").collect():
        by.setdefault(r.frame_idx, []).append(r)
    import numpy as np

    tracker, want = tracking.Tracker(max_age=5), []
    for k in range(900):
        rows = by.get(k, [])
        numbers = tracker.update(np.array([[r.x1, r.y1, r.x2, r.y2] for r in rows]).reshape(-1, 4), np.array([r.confidence for r in rows]))
        want += [(k, r.det_rank, str(n)) for r, n in zip(rows, numbers, strict=True)]
    assert ids(tracking.tracked(frames, found, max_age=5, chunk=64)[0]) == sorted(want)


def test_order_of_tracks_may_differ_unless_it_mattered():
    a, b = ((0.0, 0.0, 1.0, 1.0), 0), ((5.0, 5.0, 6.0, 6.0), 1)
    before = ([(*a, 1), (*b, 2)], False, 2)
    swapped = ([(*b, 1), (*a, 2)], False, 2)
    end = ([(*b, 1), (*a, 2), (*a, 3)], False, 1)
    alike, mine, after, carried, base = tracking.Tracking.follow(before, [4, 7], 9, swapped, end)
    assert (alike, mine, carried, base) == (True, [7, 4], [4, 7, 10], 10) and [t[2] for t in after[0]] == [2, 1, 3]
    assert not tracking.Tracking.follow(before, [4, 7], 9, swapped, (end[0], True, 1))[0]
    twins = ([(*a, 1), (*a, 2)], False, 2)
    assert tracking.Tracking.follow(twins, [4, 7], 9, twins, end)[0]
    assert not tracking.Tracking.follow(before, [4, 7], 9, ([(*a, 1)], False, 1), end)[0]


def test_suppression_ends_with_the_cooldown_or_the_last_track(spark):
    """From the events and the numbers of live tracks alone."""
    frames, found = sources(spark, SMALL)
    settings = dwell.Settings(1.0, 2.0, 1.0)
    events = dwell.dwell_events(frames, found, settings, 5.0, 5).collect()
    alive = {(r.source, r.frame_idx): r.n_active for r in tracking.tracked(frames, found, max_age=5)[1].collect()}
    bursts = {(r.source, r.frame_idx): r.segment for r in tracking.tracked(frames, found, max_age=5)[1].collect()}
    want = []
    for e in sorted(events, key=lambda e: e.end_frame):
        for track in e.track_ids:
            until, k, last = e.end_mono + settings.cooldown_s, e.end_frame, e.end_frame
            while alive.get((e.source, k)) and bursts[e.source, k] == e.segment and k / 5 < until:
                last, k = k, k + 1
            if k == e.end_frame:
                continue  # no track was alive any more when the event was told
            here = (e.source, k) in alive and bursts[e.source, k] == e.segment
            at = k / 5 if here else last / 5
            if at == e.end_mono:
                continue  # told at the very end
            want.append((e.source, track, e.end_mono, until, at, "cooldown" if at >= until else "cleared"))
    got = [(r.source, r.track_id, r.since_s, r.planned_until_s, r.ended_s, r.ended_by) for r in catalog.queries()["k3_suppressions"](spark, SMALL).collect()]
    merged = {}
    for row in sorted(want):  # a track that is ruled out again meanwhile has one row, from the first to the last
        before = merged.get(row[:2])
        if before and before[-1][4] > row[2]:
            before[-1] = (*row[:2], before[-1][2], *row[3:])
        else:
            merged.setdefault(row[:2], []).append(row)
    rounded = lambda rows: sorted((*r[:2], *(round(x, 6) for x in r[2:5]), r[5]) for r in rows)
    want = [r for rows in merged.values() for r in rows]
    assert rounded(got) == rounded(want) and len(got) > 10, (set(rounded(got)) ^ set(rounded(want)))


def test_early_clearing_of_suppression(spark):
    """All tracks die before the cooldown is over."""
    rows = [("s", k, k / 5, 0, 10.0, 10.0, 90.0, 70.0, 0.9) for k in range(20)] + [("s", 40 + k, 8 + k / 5, 0, 10.0, 10.0, 90.0, 70.0, 0.9) for k in range(3)]
    found = spark.createDataFrame(rows, "source string, frame_idx long, mono_ts double, det_rank int, x1 double, y1 double, x2 double, y2 double, confidence double")
    frames = spark.range(60).select(F.lit("s").alias("source"), F.col("id").alias("frame_idx"), (F.col("id") / 5).alias("mono_ts"))
    settings = dwell.Settings(1.0, 2.0, 1.0)
    (event,) = dwell.dwell_events(frames, found, settings, 5.0, 2).collect()
    (row,) = dwell.suppressions(frames, found, settings, 5.0, 2).collect()
    assert row.since_s == event.end_mono and row.ended_by == "cleared" and row.ended_s < row.planned_until_s


# ---- streams -----------------------------------------------------------------------------------------------------


def test_dwell_stream_in_parts_is_the_batch(spark):
    take = lambda name: sorted(map(str, catalog.queries()[name](spark, SMALL).drop("segment").collect()))
    assert take("k2_dwell_stream") == take("k2_dwell_events")


def test_every_event_leaves(spark, tmp_path):
    rows = [(k, 1000.0 + 7 * k % 50, f"n{k}") for k in range(60)] + [(7, 1049.0, "again"), (None, 1020.0, "no key"), (99, None, "no end")]
    frame = spark.createDataFrame(rows, "event_key long, s double, reason_note string").select("event_key", F.timestamp_seconds("s").alias("end_ts"), "reason_note")
    frame.write.parquet(f"{tmp_path}/in")
    stream = release.released(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"), 20.0, delay="5 seconds")
    found = release.drained(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    reasons = {(r.event_key, r.reason_note): r.reason for r in found.collect()}
    assert found.count() == len(rows) == len(reasons)
    for key, s, note in rows:
        assert reasons[key, note] == ("due" if s is None or s + 20 <= 1049 - 5 else "shutdown")


def test_released_events_go_on_after_a_restart(spark, tmp_path):
    frame = spark.range(40).select(F.col("id").alias("event_key"), F.timestamp_seconds(F.col("id") + 1000).alias("end_ts"), F.lit(0).alias("bucket_"))
    for k in range(4):
        frame.filter(F.floor(F.col("event_key") / 10) == k).write.mode("append").parquet(f"{tmp_path}/in")
        stream = release.released(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"), 12.0, delay="1 second")
        release.run_to_end(stream, f"{tmp_path}/out", f"{tmp_path}/state")
        assert sorted(r.event_key for r in spark.read.parquet(f"{tmp_path}/out").select("event_key").collect()) == list(range(max(0, 10 * k + 9 - 12)))
    left = release.left_waiting(spark, f"{tmp_path}/state", stream.schema).collect()
    assert sorted(r.event_key for r in left) == list(range(27, 40)) and stream.columns == ["event_key", "end_ts", "bucket_", "due_ms", "reason"]


def test_feed_never_repeats(spark, tmp_path):
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "event_id string")
    seen = []
    for ids_ in (["a", "b", "b", "known"], ["a", "c", "known"], ["b", "known", "d", "d"]):
        frame(ids_).write.mode("append").parquet(f"{tmp_path}/in")
        feed = release.new_once(spark.readStream.schema("event_id string").parquet(f"{tmp_path}/in"), frame(["known", "known"]))
        release.run_to_end(feed, f"{tmp_path}/out", f"{tmp_path}/state")
        seen.append(sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()))
    assert seen == [["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d"]]


def test_feed_with_kept_ids_never_repeats(spark, tmp_path, monkeypatch):
    """No id goes through Python; what is known later than at the first start is fed all the same."""
    monkeypatch.setattr(release, "_Seen", None)
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "event_id string")
    seen, known = [], ["known", "known", None]
    for ids_ in (["a", "b", "b", "known", None], ["a", "c", "known"], ["b", "known", "d", "d", None]):
        frame(ids_).write.mode("append").parquet(f"{tmp_path}/in")
        feed = release.new_once(spark.readStream.schema("event_id string").parquet(f"{tmp_path}/in"), frame(known), kept=f"{tmp_path}/known")
        release.run_to_end(feed, f"{tmp_path}/out", f"{tmp_path}/state")
        seen.append(sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()))
        known = ["known", "d"]
    assert seen == [["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d"]]
    frame(["a", None, None, "a"]).write.parquet(f"{tmp_path}/more")
    feed = release.new_once(spark.readStream.schema("event_id string").parquet(f"{tmp_path}/more"))
    release.run_to_end(feed, f"{tmp_path}/out2", f"{tmp_path}/state2")
    assert sorted(map(str, spark.read.schema("event_id string").parquet(f"{tmp_path}/out2").collect())) == ["Row(event_id='a')", "Row(event_id=None)"]


def test_frames_go_into_the_state_together():
    from unittest.mock import MagicMock

    from sightline.streaming import dwelling

    processor = dwelling._Dwelling(dwell.Settings(), 5.0, 5, 1000)
    processor.handle, processor.waiting = MagicMock(), MagicMock()
    box = {"x1": 1.0, "y1": 2.0, "x2": 3.0, "y2": 4.0, "confidence": 0.5}
    rows = [{"wall_ms": k, "frame_idx": None if k == 7 else k, "mono_ts": k / 5, "boxes": [box] * (k % 3)} for k in range(2 * dwelling.TOGETHER)]
    assert list(processor.handleInputRows(("s",), iter(rows), None)) == []
    calls = processor.waiting.method_calls
    assert len(calls) == 2 and [w[:3] for c in calls for w in c.args[0]] == [(k, k, k / 5) for k in range(len(rows)) if k != 7]
