"""Reruns, clusters, metadata files, streams and suppression on small tables."""

import json
import time

import pytest
from pyspark.sql import functions as F

from sightline.operators import gates, maintenance, reconcile
from sightline.operators.intervals import anchored_clusters, interval_join
from sightline.sources import metadata, settings
from sightline.streaming import sightings

EVENT = "event_key string, camera_id string, source_id string, start_s double, end_s double, source_start_s double, source_end_s double, provider_id string, dir_name string, event_id string, label string, label_status string, name string, label_note string, labeled_at string, recorded_s double, modified_s double"


def event(key, start, end=None, label="unknown", **more):
    base = {"event_key": key, "camera_id": "c", "source_id": "s", "start_s": float(start), "end_s": None if end is None else float(end), "dir_name": key, "event_id": f"id-{key}", "label": label, "label_status": "unlabeled" if label == "unknown" else "labeled", "recorded_s": float(start)} | more
    return tuple(base.get(f.split()[0]) for f in EVENT.split(", "))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), EVENT)


def clusters(spark, *spans):
    rows = spark.createDataFrame([("c", str(i), float(a), float(b)) for i, (a, b) in enumerate(spans)], "camera_id string, k string, a double, b double")
    return [r.cluster for r in anchored_clusters(rows, ["camera_id"], "a", "b", 5.0, "k").orderBy("k").collect()]


def test_clusters_do_not_chain_by_tolerance(spark):
    assert clusters(spark, (0, 1), (6, 7), (12, 13)) == [0, 1, 2]
    assert clusters(spark, (0, 2), (1, 3), (2, 4)) == [0, 0, 0]
    assert clusters(spark, (0, 0.5), (4, 4.5), (8, 8.5)) == [0, 0, 1]


def looped(spans, tolerance):
    out, anchor, reach, n = {}, None, None, -1
    for s, k, e in sorted(((s, k, e) for k, s, e in spans), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        e = s if e is None else e
        if s is None or anchor is None or not (s <= reach or s - anchor <= tolerance):
            n, anchor, reach = n + 1, s, e
        else:
            reach = max(reach, e)
        out[k] = n
    return out


@pytest.mark.parametrize("stretch", [7.0, 1e6])
def test_clusters_over_stretches_are_those_of_a_loop(spark, stretch):
    import random

    draw = random.Random(4)
    rows = {}
    for camera, wide in (("a", 300), ("b", 3000)):
        starts = [None if k % 50 == 0 else draw.uniform(0, wide) if k % 3 else float(draw.randrange(wide)) for k in range(150)]
        rows[camera] = [(k, s, None if s is None or k % 9 == 0 else s + draw.choice([0.5, 1.0, 12.0])) for k, s in enumerate(starts)]
    frame = spark.createDataFrame([(c, *x) for c, spans in rows.items() for x in spans], "camera_id string, k int, a double, b double")
    got = {(r.camera_id, r.k): r.cluster for r in anchored_clusters(frame, ["camera_id"], "a", "b", 5.0, "k", stretch).collect()}
    assert got == {(c, k): n for c, spans in rows.items() for k, n in looped(spans, 5.0).items()}


def test_one_long_piece_is_folded_as_a_stream(spark):
    rows = spark.range(100_000).select(F.lit("c").alias("camera_id"), "id", F.col("id").cast("double").alias("a"), (F.col("id") + F.when(F.col("id") == 0, 2e5).otherwise(1.0)).alias("b"))
    found = anchored_clusters(rows, ["camera_id"], "a", "b", 5.0, "id").groupBy("cluster").count().collect()
    assert [(r.cluster, r["count"]) for r in found] == [(0, 100_000)]


@pytest.mark.parametrize("longest", [2.0, 1e5, 1e12, float("inf")])
def test_interval_join_of_intervals_of_any_length(spark, longest):
    import random

    draw = random.Random(5)
    span = lambda i: (s := draw.uniform(0, 500), s + (longest if i % 40 == 0 else draw.choice([0.0, 0.5, 90.0])))
    left, right = ([(i % 2, i, *span(i)) for i in range(n)] for n in (150, 130))
    pairs = interval_join(spark.createDataFrame(left, "c int, l int, a double, b double"), spark.createDataFrame(right, "c int, r int, x double, y double"), ["c"], ("a", "b"), ("x", "y"), 1.0)
    got = sorted((r.l, r.r) for r in pairs.collect())
    assert got == sorted((i, j) for c, i, a, b in left for d, j, x, y in right if c == d and a <= y and x <= b)


def test_a_wrong_end_becomes_few_rows(spark):
    from sightline.operators.intervals import _dealt, _levelled

    rows = _levelled(spark.createDataFrame([(0.0, 1e9), (0.0, float("inf")), (0.0, 30.0)], "a double, b double"), ("a", "b"), 60.0)
    assert _dealt(rows, ("a", "b"), F.array(*map(F.lit, range(9))), 1, 2, 60.0).count() < 500


def test_matches(spark):
    priors = frame(spark, event("p1", 0, 2), event("p2", 1e9, 1e9 + 2, source_start_s=10.0, source_end_s=12.0), event("p3", 100, provider_id="x"), event("p4", 0, 2, source_id=""))
    new = frame(spark, event("n1", 1, 3), event("n2", 5e8, source_start_s=11.0, source_end_s=13.0), event("n3", 500, provider_id="x"), event("n4", 100))
    got = {(r.new_key, r.prior_key) for r in reconcile.matches(new, priors, 0.0).collect()}
    assert got == {("n1", "p1"), ("n2", "p2"), ("n3", "p3")}


def test_conflicting_labels_carry_nothing(spark):
    rows = frame(spark, event("a", 0, 2, "pee", labeled_at="1"), event("b", 1, 3, "poop", labeled_at="2"), event("c", 100, 101, "pee", labeled_at="3"), event("d", 101, 102))
    plan = reconcile.collapse_plan(rows, 5.0)
    assert {(r.event_key, r.action) for r in plan.collect()} == {("a", "conflict"), ("b", "conflict"), ("c", "remove"), ("d", "keep")}
    left = {r.event_key: r.label for r in reconcile.collapsed(rows, plan).collect()}
    assert left == {"a": "pee", "b": "poop", "d": "pee"}
    again = reconcile.collapsed(rows, plan)
    assert reconcile.collapse_plan(again, 5.0).filter("action = 'remove'").count() == 0


def test_recorded_claims_a_prior_once(spark):
    priors = frame(spark, event("p", 0, 2, "pee", labeled_at="1"))
    new = frame(spark, event("n1", 0, 2), event("n2", 1, 2)).withColumn("seq", F.col("event_key"))
    got = {r.event_key: (r.event_id, r.label) for r in reconcile.recorded(new, priors, 5.0).collect()}
    assert got == {"n1": ("id-p", "pee"), "n2": ("id-n2", "unknown")}


def test_label_updates(spark):
    updates = spark.createDataFrame([("p", "pee", "labeled", True, " rex ", None, "2"), ("p", "cat", "labeled", False, None, None, "3"), ("p", "pee", "labeled", True, "nobody", None, "3")], "event_key string, label string, label_status string, has_name boolean, name string, label_note string, labeled_at string")
    good, bad = maintenance.label_updates(updates, ["rex"])
    assert sorted(r.reason for r in bad.collect()) == ["label", "name"]
    (row,) = maintenance.updated(frame(spark, event("p", 0)), good).collect()
    assert (row.label, row.label_status, row.name) == ("pee", "labeled", "rex")


def test_interval_join_gives_each_pair_once(spark):
    a = spark.createDataFrame([(1, i, float(i), i + 25.0) for i in range(0, 100, 10)], "k int, a int, a0 double, a1 double")
    b = spark.createDataFrame([(1, i, float(i), i + 3.0) for i in range(0, 120, 7)], "k int, b int, b0 double, b1 double")
    got = sorted((r.a, r.b) for r in interval_join(a, b, ["k"], ("a0", "a1"), ("b0", "b1"), 4.0).collect())
    assert got == sorted((x, y) for x in range(0, 100, 10) for y in range(0, 120, 7) if x <= y + 3 and y <= x + 25)


def test_suppression(spark):
    rows = [("f", 0, 0.0, 0.0, 10.0, 10.0, 0.80, "sheep"), ("f", 1, 1.0, 0.0, 11.0, 10.0, 0.78, "dog"), ("f", 2, 50.0, 0.0, 60.0, 10.0, 0.5, "sheep")]
    found = gates.suppressed(spark.createDataFrame(rows, "frame string, det_rank int, x1 double, y1 double, x2 double, y2 double, confidence double, class_name string"), ["frame"], 0.5)
    assert sorted((r.class_name, r.x1) for r in found.collect()) == [("dog", 1.0), ("sheep", 50.0)]


def test_camera_settings(spark):
    rows = spark.createDataFrame([("a", 0.5, 1.0), ("b", 1.5, 1.0), ("c", 0.5, 0.0)], "camera_id string, detection_conf_threshold double, event_duration_s double")
    assert [r.problem for r in settings.checked_cameras(rows).orderBy("camera_id").collect()] == [None, "detection_conf_threshold", "event_duration_s"]
    with pytest.raises(Exception, match="bad camera setting"):
        settings.strict_cameras(rows).collect()


def test_metadata_files(spark, tmp_path):
    for name, text in (("e1", json.dumps({"camera_id": "c", "sanitized_source_id": "s", "utc_ts": "2026-06-06T09:10:47Z", "source_start_s": "not a number"})), ("e2", "{broken"), ("e3", "[]")):
        folder = tmp_path / "Cam" / "2026-06-06" / "events" / name
        folder.mkdir(parents=True)
        (folder / "metadata.json").write_text(text)
    (tmp_path / "Cam" / "metadata.json").write_text("{}")
    rows = metadata.read_events(spark, str(tmp_path)).filter("camera_id is not null").collect()
    assert [(r.event_id, r.camera_dir, r.date_dir) for r in rows] == [("e1", "Cam", "2026-06-06")]
    assert metadata.bad_events(spark, str(tmp_path)).count() >= 1


def test_clips_labels_recordings_and_checksums(spark, tmp_path):
    for name, video in (("a", True), ("b", False)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata.json").write_text(json.dumps({"span_id": name, "fps": 10.0}))
        (tmp_path / name / "labels.json").write_text(json.dumps({"clip": name, "ranges": [{"start_frame": 0, "end_frame": 5, "behavior": "pee"}]}))
        if video:
            (tmp_path / name / "clip.mp4").write_bytes(b"x")
    (tmp_path / "z.MOV").write_bytes(b"y")
    root = str(tmp_path)
    assert [r.span_id for r in metadata.read_clips(spark, root).collect()] == ["a"]
    assert [(r.clip, r.end_frame) for r in metadata.read_label_ranges(spark, root).collect()] == [("a", 5)]
    assert [r.path.rsplit("/", 1)[1] for r in metadata.recordings(spark, root).collect()] == ["clip.mp4", "z.MOV"]
    assert metadata.checksums(spark, root, "*.MOV").first().checksum == "a1fce4363854ff888cff4b8e7875d600c2682390412a8cf79b37d0b11148b0fa"


def test_dwell_stream(spark, tmp_path):
    schema = "source string, frame_idx int, mono_ts double, wall_ts timestamp, boxes array<struct<x1:double,y1:double,x2:double,y2:double,confidence:double>>"
    rows = [("cam", f, float(f), 1_700_000_000 + f, [(40.0, 20.0, 80.0, 100.0, 0.9)] if f < 9 else []) for f in range(60)]
    base = spark.createDataFrame(rows, "source string, frame_idx int, mono_ts double, w long, boxes array<struct<x1:double,y1:double,x2:double,y2:double,confidence:double>>")
    base.withColumn("wall_ts", F.timestamp_seconds("w")).drop("w").orderBy("frame_idx").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    found = sightings.dwell_stream(stream, sightings.Settings(1.0, 5.0, 2.0), delay="1 second")
    run = found.writeStream.format("memory").queryName("dwell_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    run.processAllAvailable()
    time.sleep(1)
    run.processAllAvailable()
    run.stop()
    (got,) = spark.sql("select * from dwell_out").collect()
    assert got.primary_track_id == "1" and got.start_frame == 0 and got.end_frame == 7


def test_reconcile_sink(spark, tmp_path):
    sink = sightings.reconcile_sink(str(tmp_path), 5.0)
    sink(frame(spark, event("p", 0, 2, "pee", labeled_at="1")).withColumn("seq", F.lit(1)), 0)
    for _ in range(2):  # the second is a repeat
        sink(frame(spark, event("n", 1, 3)).withColumn("seq", F.lit(2)), 1)
    assert sightings.versions(spark, str(tmp_path)) == [0, 1]
    assert [(r.event_key, r.event_id, r.label) for r in spark.read.parquet(f"{tmp_path}/version=1").collect()] == [("n", "id-p", "pee")]


def drained(frame, name, path):
    run = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(path)).start()
    run.processAllAvailable()
    run.stop()
    return frame.sparkSession.sql(f"select * from {name}")


def test_feed_gives_each_new_event_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, ids in enumerate((("a", "b"), ("b", "c", "old"))):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"event_id": i, "recorded_at": "2026-01-01T00:00:00Z"}) for i in ids))
    known = spark.createDataFrame([("old",)], "event_id string")
    feed = sightings.new_events(spark, str(tmp_path / "in"), "event_id string, recorded_at timestamp", known)
    assert sorted(r.event_id for r in drained(feed, "feed_out", tmp_path / "ck").collect()) == ["a", "b", "c"]


def test_events_wait_for_their_post_roll(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0), ("b", 100), ("c", 1000)], "event_key string, s long").select("event_key", F.timestamp_seconds("s").alias("end_ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_key string, end_ts timestamp").parquet(str(tmp_path / "in"))
    got = drained(sightings.released(stream, 30.0), "released_out", tmp_path / "ck").collect()
    assert sorted(r.event_key for r in got) == ["a", "b"]  # the last waits for time to pass


def test_manifest_file(spark, tmp_path):
    crop = "struct<x1:double,y1:double>"
    rows = spark.createDataFrame([("behavior/train/pee/a.jpg", "", "pee", "unknown", "1", 3, "cam@x", "2024-02-03", "train", 1, 7, (1.0, 2.0)), ("behavior/val/poop/b.jpg", "dog/val/rex/b.jpg", "poop", "rex", "", 4, None, "2024-02-04", "val", 1, 8, None)], f"behavior_path string, name_path string, behavior string, name string, track_id string, clip int, source_id string, day string, split string, matched int, frame_idx int, crop {crop}")
    metadata.write_manifest(rows.coalesce(1), str(tmp_path / "m"))
    (file,) = (tmp_path / "m").glob("*.csv")
    lines = file.read_text().splitlines()
    assert lines[0] == "crop_path,dog_crop_path,behavior,dog,track_id,clip_id,source_id,date,split,matched"
    assert lines[1] == "behavior/train/pee/a.jpg,,pee,unknown,1,3,cam@x,2024-02-03,train,1" and len(lines) == 3
    metadata.write_manifest(rows.limit(0), str(tmp_path / "none"))


def test_written_files_and_checksums(spark, tmp_path):
    import hashlib

    rows = spark.createDataFrame([("a/b/x.txt", "one"), ("a/y.txt", "é" * 700_000), ("z.txt", "")], "path string, text string")
    for _ in range(2):  # the second replaces the first
        assert metadata.write_files(rows, str(tmp_path)) == 3
    assert (tmp_path / "a/b/x.txt").read_text() == "one"
    got = {r.path.rsplit("/", 1)[1]: r.checksum for r in metadata.checksums(spark, str(tmp_path), "*.txt").collect()}
    assert got == {"x.txt": hashlib.sha256(b"one").hexdigest(), "y.txt": hashlib.sha256(("é" * 700_000).encode()).hexdigest()}  # Spark lists no empty file
    assert metadata.write_files(rows.limit(0), str(tmp_path)) == 0


def test_streams_of_registered_queries(spark):
    from sightline.plans import catalog

    sf_dir = "/root/testdata/sf0.001"
    events = catalog.queries()["k6_new_event_feed"](spark, sf_dir)
    known = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert events.count() == events.distinct().count() == known.filter("event_id % 4 <> 0").count()
    assert catalog.queries()["k5_released"](spark, sf_dir).count() == known.count() - 1  # the last waits for time to pass
    cooled = catalog.queries()["k3_cooldown"](spark, sf_dir)
    assert cooled.filter("until_s - since_s <> 2").count() == 0 and cooled.count()
