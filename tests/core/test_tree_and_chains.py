"""Trees of files with pruning, and chains of repeats."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNull

from sightline.operators import spans
from sightline.sources import metadata, tree


@pytest.fixture
def root(tmp_path):
    for camera in ("A", "B", "C d"):
        for day in ("2024-01-01", "2024-01-02"):
            for n in range(3):
                at = tmp_path / camera / day / "events" / f"e{n}"
                at.mkdir(parents=True)
                text = {0: json.dumps({"event_id": f"{camera}{day}{n}", "label": "pee", "source_start_s": "x"}), 1: "{broken", 2: json.dumps({"label": "poop", "unknown": 1})}[n]
                (at / "metadata.json").write_text(text)
                (at / "other.json").write_text("{}")
    (tmp_path / "A" / "2024-01-01" / "events" / "empty").mkdir()
    (tmp_path / "stray.txt").write_text("x")
    return tmp_path


class Watched:
    """A file system that notes what is listed and opened."""

    def __init__(self, system):
        self.system, self.listed, self.opened = system, [], []

    def get_file_info(self, what):
        self.listed.append(getattr(what, "base_dir", what))
        return self.system.get_file_info(what)

    def open_input_stream(self, path):
        self.opened.append(path)
        return self.system.open_input_stream(path)


def watched(root, monkeypatch, *filters):
    system, top = metadata.opened(str(root))
    seen = Watched(system)
    monkeypatch.setattr(tree, "opened", lambda path: (seen, top))
    reader = tree.TreeReader(str(root), tree.EVENT_FILES, 2, 1, True)
    left = list(reader.pushFilters(list(filters)))
    rows = [row for place in reader.partitions() for row in reader.read(place)]
    return rows, seen, left


def test_a_filter_opens_its_own_files_only(root, monkeypatch):
    rows, seen, left = watched(root, monkeypatch, EqualTo(("camera_dir",), "B"), IsNull(("text",)))
    assert len(rows) == 6 == len(seen.opened) and all("/B/" in f for f in seen.opened) and len(left) == 1
    assert not any("/A/" in str(at) or "/C d/" in str(at) for at in seen.listed)
    rows, seen, left = watched(root, monkeypatch, In(("camera_dir",), ("A", "C d")), GreaterThanOrEqual(("date_dir",), "2024-01-02"), EqualTo(("dir_name",), "e1"))
    assert sorted(r[:3] for r in rows) == [("A", "2024-01-02", "e1"), ("C d", "2024-01-02", "e1")] and len(seen.opened) == 2 and not left
    assert len(watched(root, monkeypatch)[1].opened) == 18


def test_tree_reads_what_the_scan_reads(spark, root):
    columns = ["camera_dir", "date_dir", "dir_name", "event_id", "label", "source_start_s"]
    found = sorted(map(str, tree.read_event_tree(spark, str(root), 2).select(*columns).collect()))
    assert found == sorted(map(str, metadata.read_events(spark, str(root)).select(*columns).collect())) and len(found) == 12
    some = tree.read_event_tree(spark, str(root)).filter("camera_dir = 'C d' and label = 'pee'").select("event_id").collect()
    assert sorted(r.event_id for r in some) == ["C d2024-01-010", "C d2024-01-020"]


def test_tree_of_nothing(spark, tmp_path):
    assert tree.read_event_tree(spark, str(tmp_path)).collect() == [] and tree.read_event_tree(spark, f"{tmp_path}/missing").collect() == []


# ---- chains ------------------------------------------------------------------------------------------------------


def brute(links: list[tuple[int, int]]) -> list[int]:
    rivals: dict[int, set[int]] = {}
    for late, early in links:
        rivals.setdefault(late, set()).add(early)
    stands: dict[int, bool] = {}
    for n in sorted({n for link in links for n in link}):
        stands[n] = not any(stands[e] for e in rivals.get(n, ()))
    return sorted(n for n in stands if not stands[n])


def test_overruled_is_brute_force(spark):
    r = random.Random(3)
    for reach in (2, 5, 40):
        links = [(b, a) for b in range(1, 50) for a in r.sample(range(b), min(b, r.choice([0, 1, 1, 1, 2, 3]))) if b - a <= reach]
        found = spans.overruled(spark.createDataFrame([*links, *links[:5]], "late long, early long")).collect()
        assert sorted(x.node for x in found) == brute(links)
    assert spans.overruled(spark.createDataFrame([], "late long, early long")).collect() == []


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds, keep = 10_000, [0], spans.settled

    def counted(frame):
        rounds[0] += "next" in frame.columns
        return keep(frame)

    monkeypatch.setattr(spans, "settled", counted)
    links = [(k + 1, k) for k in range(n)]
    found = spans.overruled(spark.createDataFrame(links, "late long, early long")).collect()
    assert sorted(x.node for x in found) == list(range(1, n + 1, 2)) and rounds[0] <= 20


def test_event_files_of_late_clips(spark, tmp_path):
    """Clips whose seconds (from 5,180 on) or days (from 24,856 on) pass an int."""
    from sightline.plans import catalog

    clips = (1, 3, 5200, 25000)
    rows = [(1000 * c + 60 * b + k, 1, 5.0) for c in clips for b in range(3) for k in (0, 9)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {(f"Cam{c}", f"e{100 * c + b:08d}", 1_700_000_000.0 + 86_400 * c + 12 * b) for c in clips for b in range(3) if (100 * c + b) % 7 and (100 * c + b) % 11}
    for name in ("a1_event_scan", "a1_event_tree"):
        assert {(r.camera_dir, r.dir_name, r.start_s) for r in catalog.queries()[name](spark, str(tmp_path)).collect()} == want
    some = {r.dir_name for r in catalog.queries()["a1_some_cameras"](spark, str(tmp_path)).collect()}
    assert some == {n for c, n, _ in want if c == "Cam3"} and {c for c, _, _ in want} == {f"Cam{c}" for c in clips}
