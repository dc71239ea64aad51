"""Tracks and dwell events over a stream of detections, the state of a source in parts.

Frames wait in a list until the watermark has passed them and are then taken in their order by the same tracker and
machine as in batch. Tracks, stationary runs and suppressed tracks are maps, the machine's window and candidate a value:
a batch of frames reads them once, and writes back what changed. Suppressed tracks leave their map when their time, which
is the frames' own, is over. A source that stays silent for idle_ms past the watermark is flushed and forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.dwell import Posture, Settings
from .release import stateful
from .sightings import EVENTS, Live

BOXES = "array<array<double>>"
#: Frames that one call puts into the state.
TOGETHER = 4096
#: The parts of a source's state.
WAITING = f"wall_ms long, frame long, mono double, boxes {BOXES}, confidence array<double>"
TRACK = f"place int, last array<double>, missed int, times array<double>, boxes {BOXES}"
POSTURE = "struct<track:string,span_s:double,motion_px:double,window_start:double,stationary:boolean>"
MACHINE = (
    "state string, born long, latest long, last_mono double, last_frame long, "
    "opened struct<mono:double,frame:long,tracks:array<string>,boxes:long,multi:boolean,ambiguous:boolean>, "
    f"chosen struct<track:string,due:double,best:{POSTURE},dwell:double>, near {POSTURE}"
)


def _values(posture: Posture | None) -> tuple | None:
    return None if posture is None else (posture.track, float(posture.span_s), float(posture.motion_px), float(posture.window_start), bool(posture.stationary))


class _Dwelling(StatefulProcessor):
    def __init__(self, settings: Settings, sample_rate_fps: float, max_age: int, idle_ms: int):
        self.make, self.idle_ms = (settings, sample_rate_fps, max_age), idle_ms
        self.names = [c.split()[0] for c in EVENTS.split(", ")][1:]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.machine = handle.getValueState("machine", MACHINE)
        self.tracks = handle.getMapState("tracks", "track string", TRACK)
        self.runs = handle.getMapState("runs", "track string", "since double")
        self.suppressed = handle.getMapState("suppressed", "track string", "until double")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        newest, waiting = None, []
        for row in rows:
            wall = int(row["wall_ms"])
            newest = wall if newest is None else max(newest, wall)
            if row["frame_idx"] is not None:  # else the source only tells the time
                boxes = row["boxes"] or []
                waiting.append((wall, row["frame_idx"], row["mono_ts"], [[b[c] for c in ("x1", "y1", "x2", "y2")] for b in boxes], [b["confidence"] for b in boxes]))
                if len(waiting) >= TOGETHER:
                    self.waiting.appendList(waiting)
                    waiting = []
        if waiting:
            self.waiting.appendList(waiting)
        if newest is not None:
            self.handle.registerTimer(newest)
            self.handle.registerTimer(newest + self.idle_ms)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = list(self.waiting.get())
        ready = sorted((w for w in waiting if w[0] <= now), key=lambda w: w[1])
        if not ready and (waiting or not self.machine.exists()):
            return  # nothing is due, and a source without a machine has nothing to end
        live, before = self._load()
        events = []
        for wall, frame, mono, boxes, confidence in ready:
            events += live.frame(frame, mono, np.array(boxes, float).reshape(-1, 4), np.array(confidence, float))
            live.latest = max(live.latest, wall)
        if len(ready) == len(waiting) and now >= live.latest + self.idle_ms:
            events += live.machine.flush()
            for part in (self.waiting, self.machine, self.tracks, self.runs, self.suppressed):
                part.clear()
        elif ready:
            later = [tuple(w) for w in waiting if w[0] > now]
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
            self._save(live, before)
        for event in events:
            yield Row(source=key[0], **{n: event[n] for n in self.names})

    def _load(self) -> tuple[Live, dict]:
        """The source as it was left, and its maps as they are stored."""
        live = Live(*self.make)
        stored = {name: {k[0]: tuple(v) for k, v in part.iterator()} for name, part in self._maps().items()}
        for track, (_, last, missed, times, boxes) in sorted(stored["tracks"].items(), key=lambda x: x[1][0]):
            live.tracker.numbers.append(int(track))
            live.tracker.last.append(list(last))
            live.tracker.missed.append(missed)
            if times:
                live.recent[track] = [(t, tuple(b)) for t, b in zip(times, boxes, strict=True)]
        machine = live.machine
        machine.runs = {k: v[0] for k, v in stored["runs"].items()}
        machine.until = {k: v[0] for k, v in stored["suppressed"].items()}
        if self.machine.exists():
            state, born, live.latest, mono, frame, opened, chosen, near = self.machine.get()
            machine.state, live.tracker.born = state, born
            machine.last = None if mono is None else (mono, frame)
            if opened is not None:
                machine.opened = dict(zip(("mono", "frame", "tracks", "boxes", "multi", "ambiguous"), opened, strict=True))
                machine.opened["tracks"] = set(machine.opened["tracks"])
            if chosen is not None:
                track, due, best, dwell = chosen
                machine.chosen = {"track": track, "due": due, "best": Posture(*best), "dwell": dwell}
            machine.near = None if near is None else Posture(*near)
        return live, stored

    def _maps(self) -> dict:
        return {"tracks": self.tracks, "runs": self.runs, "suppressed": self.suppressed}

    def _save(self, live: Live, before: dict) -> None:
        tracker, machine = live.tracker, live.machine
        tracks = {}
        for place, (number, last, missed) in enumerate(zip(tracker.numbers, tracker.last, tracker.missed, strict=True)):
            recent = live.recent.get(str(number), [])
            tracks[str(number)] = (place, [float(c) for c in last], int(missed), [float(t) for t, _ in recent], [[float(c) for c in b] for _, b in recent])
        after = {"tracks": tracks, "runs": {k: (float(v),) for k, v in machine.runs.items()}, "suppressed": {k: (float(v),) for k, v in machine.until.items()}}
        for name, part in self._maps().items():
            for k in before[name].keys() - after[name].keys():
                part.removeKey((k,))
            for k, v in after[name].items():
                if before[name].get(k) != v:
                    part.updateValue((k,), v)
        o, c = machine.opened, machine.chosen
        self.machine.update((
            machine.state, tracker.born, int(live.latest), *(machine.last or (None, None)),
            (float(o["mono"]), int(o["frame"]), sorted(o["tracks"]), int(o["boxes"]), bool(o["multi"]), bool(o["ambiguous"])) if o else None,
            (c["track"], float(c["due"]), _values(c["best"]), float(c["dwell"])) if c else None,
            _values(machine.near),
        ))

    def close(self) -> None:
        pass


def dwell_stream(frames: DataFrame, settings: Settings | None = None, sample_rate_fps: float = 1.0, max_age: int | None = None, delay: str = "10 seconds", idle_ms: int = 60_000) -> DataFrame:
    """frames: source, frame_idx, mono_ts, wall_ts, and boxes (array<struct<x1,y1,x2,y2,confidence>>, empty for a frame
    without any; a row without frame_idx only tells the time). Events come out when the watermark has passed them;
    frames that come delay or more after later ones are dropped by it."""
    stateful(frames.sparkSession)
    age = max(1, round(sample_rate_fps)) if max_age is None else max_age
    marked = frames.withColumn("wall_ms", F.unix_millis("wall_ts")).withWatermark("wall_ts", delay)
    processor = _Dwelling(settings or Settings(), sample_rate_fps, age, idle_ms)
    return marked.groupBy("source").transformWithState(processor, EVENTS, "append", "eventTime")
