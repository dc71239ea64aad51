"""Changes applied to the event table on disk."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from sightline.sources import event_table

SCHEMA = "event_key long, camera_id string, source_id string, start_s double, end_s double, source_start_s double, source_end_s double, provider_id string, dir_name string, event_id string, label string, label_status string, name string, label_note string, labeled_at string, recorded_s double, modified_s double, camera_dir string, date_dir string"


def event(key, camera, start, label="unknown", status="unlabeled", day=None, recorded=None):
    at = "2024-01-01" if status != "unlabeled" else None
    return (key, camera, "src", start, start + 5, None, None, None, f"e{key}", f"id{key}", label, status, None, None, at, recorded, start, f"Cam{camera}", day or f"2024-01-0{1 + int(start) // 1000}")


ROWS = [event(1, "a", 0.0), event(2, "a", 100.0, "pee", "labeled"), event(3, "a", 1000.0), event(4, "b", 0.0), event(5, "b", 2000.0), event(6, "c=d/e", 0.0), event(7, "x", 0.0, day="")]


@pytest.fixture
def path(spark, tmp_path):
    event_table.create(spark.createDataFrame(ROWS, SCHEMA), f"{tmp_path}/table")
    return f"{tmp_path}/table"


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def keys_of(spark, path):
    return sorted(r.event_key for r in event_table.read(spark, path).collect())


def ids(spark, *ids_):
    return spark.createDataFrame([(i,) for i in ids_], "event_key long")


def test_only_touched_partitions_are_rewritten(spark, path):
    before = files(path)
    done = event_table.change(spark, path, removed=ids(spark, 1, 4, 4, 999), trash=f"{path}-trash", stamp="s1")
    after = files(path)
    assert (done.partitions, done.removed, done.written, done.left) == (2, 2, 0, 1) and keys_of(spark, path) == [2, 3, 5, 6, 7]
    # Camera b's day is empty now and gone; one day of camera a is new; the rest are the files they were.
    gone = {f for f in before - after}
    assert len(gone) == 2 and len(after - before) == 1 and not os.path.exists(f"{path}/camera_dir=Camb/date_dir=2024-01-01")
    assert sorted(r.event_key for r in spark.read.parquet(f"{path}-trash").collect()) == [1, 4]
    event_table.restore(spark, path, f"{path}-trash", "s1")
    assert sorted(map(str, event_table.read(spark, path).select(*SCHEMA_NAMES).collect())) == sorted(map(str, spark.createDataFrame(ROWS, SCHEMA).withColumn("date_dir", F.nullif("date_dir", F.lit(""))).collect()))


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def test_odd_partitions_can_become_empty(spark, path):
    event_table.change(spark, path, removed=ids(spark, 6, 7))
    assert keys_of(spark, path) == [1, 2, 3, 4, 5] and len(files(path)) == 4


def test_a_row_that_moves_leaves_its_old_partition(spark, path):
    event_table.change(spark, path, written=spark.createDataFrame([event(4, "b", 1500.0, "poop", "labeled"), event(8, "new", 0.0)], SCHEMA))
    rows = {r.event_key: r for r in event_table.read(spark, path).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6, 7, 8] and rows[4].date_dir == "2024-01-02" and rows[4].label == "poop"


def test_nothing_to_change_changes_nothing(spark, path):
    before = files(path)
    assert event_table.change(spark, path) == event_table.Change(0, 0, 0, 0) and files(path) == before


def test_no_labelled_event_goes_to_the_trash(spark, path):
    before = files(path)
    states = spark.createDataFrame([(1, "removable"), (2, "removable")], "event_key long, state string")
    with pytest.raises(RuntimeError, match="labelled"):
        event_table.quarantine(spark, path, states, f"{path}-trash", "s1")
    assert files(path) == before
    event_table.quarantine(spark, path, states.filter("event_key = 1"), f"{path}-trash", "s1")
    assert keys_of(spark, path) == [2, 3, 4, 5, 6, 7]


def test_collapse_keeps_labels(spark, path):
    more = spark.createDataFrame([event(10, "a", 103.0, recorded=900.0), event(11, "a", 106.0, recorded=500.0)], SCHEMA)
    event_table.change(spark, path, written=more)
    event_table.collapse(spark, path, 10.0, f"{path}-trash", "s1")
    rows = {r.event_key: r for r in event_table.read(spark, path).collect()}
    # 2 (labelled) and 11 give way to 10, the newest recording, which gets the label.
    assert sorted(k for k in rows if rows[k].camera_id == "a" and rows[k].start_s < 200) == [1, 10]
    assert (rows[10].label, rows[10].label_status) == ("pee", "labeled")


def test_a_run_that_broke_off_goes_on(spark, path, monkeypatch):
    new = spark.createDataFrame([(*event(20, "a", 102.0), 1), (*event(21, "b", 2003.0), 2)], SCHEMA + ", seq long")
    whole, calls = event_table.change, []

    def broken(*args, **how):
        calls.append(how)
        if len(calls) == 2:  # the new rows are there, the superseded not gone yet
            raise OSError("lost")
        return whole(*args, **how)

    monkeypatch.setattr(event_table, "change", broken)
    with pytest.raises(OSError, match="lost"):
        event_table.record(spark, path, new, 10.0)
    assert keys_of(spark, path) == [1, 2, 3, 4, 5, 6, 7, 20, 21]
    event_table.record(spark, path, new, 10.0)
    assert keys_of(spark, path) == [1, 3, 4, 6, 7, 20, 21]
    rows = {r.event_key: r for r in event_table.read(spark, path).collect()}
    assert (rows[20].event_id, rows[20].label) == ("id2", "pee") and rows[21].event_id == "id5"
    before = files(path)
    assert event_table.record(spark, path, new, 10.0) == event_table.Change(0, 0, 0, 0) and files(path) == before
