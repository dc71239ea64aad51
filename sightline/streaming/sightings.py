"""Tracks and dwell events over a stream of detections. Rows of a source wait in its state until the watermark has
passed their wall time, are taken in frame order by the same tracker and machine as in batch, and go; late rows are
dropped by the watermark. When no track is alive the state is empty but for what waits."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.dwell import Machine, Posture, Settings, apart
from ..operators.tracking import Tracker

STATE = "held binary"
EVENTS = "source string, start_mono double, end_mono double, start_frame long, end_frame long, primary_track_id string, track_ids array<string>, n_detections long, multi boolean, ambiguous boolean, near_miss boolean, stationary_duration_s double, dwell_duration_s double, confidence double"


class Live:
    """One source: its tracker, its machine, the trailing boxes of its tracks, the rows that wait."""

    def __init__(self, settings: Settings, sample_rate_fps: float, max_age: int):
        self.settings, self.tracker, self.machine = settings, Tracker(max_age=max_age), Machine(settings)
        interval = 1.0 / sample_rate_fps if sample_rate_fps > 0 else 0.0
        self.tolerance = min(max(1e-3, 0.15 * settings.stationary_threshold_s, 2.0 * interval), 0.5 * settings.stationary_threshold_s)
        self.recent: dict[str, list[tuple[float, Sequence[float]]]] = {}
        self.waiting: list[tuple] = []  # wall (milliseconds), frame, mono, boxes, confidences
        self.latest = 0.0

    def take(self, until: float) -> list[dict]:
        """Processes the frames that wait with a wall time before until, in frame order."""
        ready = sorted((w for w in self.waiting if w[0] < until), key=lambda w: w[1])
        self.waiting = [w for w in self.waiting if w[0] >= until]
        return [e for _, frame, mono, boxes, confidence in ready for e in self.frame(frame, mono, boxes, confidence)]

    def frame(self, frame: int, mono: float, boxes: np.ndarray, confidence: np.ndarray) -> list[dict]:
        numbers = self.tracker.update(boxes, confidence)
        current = []
        for n, box in sorted((n, tuple(b)) for n, b in zip(numbers.tolist(), boxes.tolist(), strict=True) if n >= 0):
            track = self.recent.setdefault(str(n), [])
            track.append((mono, box))
            if track[0][0] < mono - self.settings.stationary_threshold_s:
                track[:] = [x for x in track if x[0] >= mono - self.settings.stationary_threshold_s]
            current.append(self.posture(str(n), track))
        alive = set(map(str, self.tracker.numbers))
        if not self.recent.keys() <= alive:
            self.recent = {t: x for t, x in self.recent.items() if t in alive}
        return self.machine.frame(mono, frame, boxes, current, len(alive))

    def posture(self, track: str, recent: list[tuple[float, Sequence[float]]]) -> Posture:
        """In the order of operations of the batch fold (dwell.Trails); for a few boxes plain numbers are quicker."""
        middle = [((b[0] + b[2]) / 2, (b[1] + b[3]) / 2) for _, b in recent]
        x, y = middle[0]
        motion = max(apart(a - x, b - y) for a, b in middle)
        diagonals = sorted(apart(max(b[2] - b[0], 0.0), max(b[3] - b[1], 0.0)) for _, b in recent)
        span = max(0.0, recent[-1][0] - recent[0][0])
        covered = span >= self.settings.stationary_threshold_s - self.tolerance and len(recent) >= 2
        return Posture(track, span, motion, recent[0][0], covered and motion <= max(10.0, 0.2 * diagonals[len(diagonals) // 2]))


def dwell_stream(frames: DataFrame, settings: Settings | None = None, sample_rate_fps: float = 1.0, max_age: int | None = None, delay: str = "10 seconds", idle_ms: int = 60_000) -> DataFrame:
    """frames: source, frame_idx, mono_ts, wall_ts, and boxes (array<struct<x1,y1,x2,y2,confidence>>, empty for a frame
    without any). Events come out when the watermark has passed them; a source that stays silent for idle_ms past the
    watermark is flushed and forgotten."""
    settings = settings or Settings()
    age = max(1, round(sample_rate_fps)) if max_age is None else max_age
    names = [c.split()[0] for c in EVENTS.split(", ")][1:]

    def run(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        live: Live = pickle.loads(state.get[0]) if state.exists else Live(settings, sample_rate_fps, age)
        for pdf in batches:
            for row in pdf.itertuples():
                boxes = np.array([[b[c] for c in ("x1", "y1", "x2", "y2")] for b in row.boxes], float).reshape(-1, 4)
                live.waiting.append((row.wall_ts.timestamp() * 1000, int(row.frame_idx), float(row.mono_ts), boxes, np.array([b["confidence"] for b in row.boxes], float)))
        live.latest = max([live.latest, *(w[0] for w in live.waiting)])
        mark = state.getCurrentWatermarkMs()
        if state.hasTimedOut and mark >= live.latest + idle_ms:
            out = live.take(float("inf")) + live.machine.flush()
            state.remove()
        else:
            out = live.take(mark)
            state.update((pickle.dumps(live),))
            due = min((w[0] for w in live.waiting), default=live.latest + idle_ms)
            state.setTimeoutTimestamp(int(max(due, mark + 1)))
        found = pd.DataFrame(out, columns=names)
        found.insert(0, "source", key[0])
        yield found

    marked = frames.withWatermark("wall_ts", delay).select("source", "frame_idx", "mono_ts", "wall_ts", "boxes")
    return marked.groupBy("source").applyInPandasWithState(run, EVENTS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def released(events: DataFrame, post_roll_s: float, delay: str = "0 seconds") -> DataFrame:
    """Events of a stream once the watermark has passed their end and post-roll. events: event_key, end_ts, and more."""
    kept = [c for c in events.columns if c != "end_ts"]
    due = events.withColumn("due_ts", F.timestamp_micros(F.unix_micros("end_ts") + F.lit(int(post_roll_s * 1e6)))).withWatermark("due_ts", delay)
    windows = due.groupBy(F.window("due_ts", "1 second"), "event_key").agg(F.first("end_ts").alias("end_ts"), *(F.first(c).alias(c) for c in kept if c != "event_key"))
    return windows.select("event_key", "end_ts", *(c for c in kept if c != "event_key"))


def new_events(spark: SparkSession, path: str, schema: str, known: DataFrame | None = None, delay: str = "1 hour") -> DataFrame:
    """The feed of events that are new in a folder of JSON files: each id once, none of those known at the start."""
    feed = spark.readStream.schema(schema).json(path).withWatermark("recorded_at", delay).dropDuplicatesWithinWatermark(["event_id"])
    return feed if known is None else feed.join(known.select("event_id").distinct(), "event_id", "left_anti")


def reconcile_sink(path: str, tolerance_s: float):
    """For foreachBatch: each batch of new events is settled against the table as it stood before the batch, and the
    result becomes the table's next version (a folder of its own; the newest version is the table)."""
    from ..operators.reconcile import recorded

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = versions(spark, path)
        if number in done:  # a batch that is tried again after it was written
            return
        priors = spark.read.parquet(f"{path}/version={max(done)}") if done else batch.drop("seq").limit(0)
        recorded(batch, priors, tolerance_s).write.mode("overwrite").parquet(f"{path}/version={number}")

    return write


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that were written wholly."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [s.getPath() for s in files.listStatus(root)]
    return sorted(int(p.getName().split("=")[1]) for p in names if p.getName().startswith("version=") and files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
