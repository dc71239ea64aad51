"""Sustained-dwell events: a subject that stands still long enough opens a candidate, which is emitted a little later.

A burst's frames are folded once, in order: each track's trailing window is a queue of what it still spans, from which
the machine learns whether the track stands still. Bursts are folded in chunks (see chunked). The same machine serves
streams.
"""

from __future__ import annotations

import copy
import itertools
import math
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass, field, fields

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunked import CHUNK, by_chunk
from .tracking import iou, located, overlaps

EVENTS = "source string, segment long, start_mono double, end_mono double, start_frame long, end_frame long, primary_track_id string, track_ids array<string>, n_detections long, multi boolean, ambiguous boolean, near_miss boolean, stationary_duration_s double, dwell_duration_s double, confidence double"
IDLE, WATCHING, CANDIDATE = "idle", "watching", "candidate"
AMBIGUOUS_IOU = 0.2


@dataclass
class Settings:
    stationary_threshold_s: float = 1.0
    dwell_trigger_s: float = 5.0
    event_duration_s: float = 2.0
    near_misses: bool = False

    @property
    def cooldown_s(self) -> float:
        return max(self.dwell_trigger_s, self.stationary_threshold_s, self.event_duration_s)


@dataclass
class Posture:
    """A current track's trailing window."""

    track: str
    span_s: float
    motion_px: float
    window_start: float
    stationary: bool


@dataclass
class Machine:
    settings: Settings
    state: str = IDLE
    opened: dict = field(default_factory=dict)  # the window: mono, frame, tracks, boxes, multi, ambiguous
    runs: dict[str, float] = field(default_factory=dict)  # track to the start of its stationary run
    chosen: dict = field(default_factory=dict)  # the candidate: track, due, best, dwell
    near: Posture | None = None
    until: dict[str, float] = field(default_factory=dict)  # suppressed tracks
    last: tuple[float, int] | None = None

    def frame(self, mono: float, number: int, boxes: np.ndarray, current: list[Posture], n_active: int) -> list[dict]:
        """One sampled frame: all gated boxes, the tracks seen in it, and how many tracks are alive."""
        self.last, out = (mono, number), []
        self.until = {t: u for t, u in self.until.items() if mono < u}
        if any(p.track not in self.until for p in current):
            if self.state == IDLE:
                self.reset(WATCHING)
                self.opened = {"mono": mono, "frame": number, "tracks": set(), "boxes": 0, "multi": False, "ambiguous": False}
            self.look(boxes, current)
            self.weigh(mono, current)
        elif self.state == WATCHING:
            self.reset()
        if self.state == CANDIDATE and mono >= self.chosen["due"]:
            out.append(self.event(mono, number))
            self.reset()
        if not n_active:
            if self.state == CANDIDATE or (self.state == WATCHING and self.settings.near_misses and self.near):
                out.append(self.event(mono, number))
            self.reset()
            self.until = {}
        return out

    def flush(self) -> list[dict]:
        """The end of the stream."""
        due = self.last and (self.state == CANDIDATE or (self.state == WATCHING and self.settings.near_misses and self.near))
        out = [self.event(*self.last)] if due else []
        self.reset()
        self.until = {}
        return out

    def reset(self, state: str = IDLE) -> None:
        self.state, self.opened, self.runs, self.chosen, self.near = state, {}, {}, {}, None

    def look(self, boxes: np.ndarray, current: list[Posture]) -> None:
        seen = self.opened
        seen["boxes"] += len(boxes)
        seen["tracks"] |= {p.track for p in current}
        if len(seen["tracks"]) > 1:
            seen["multi"] = seen["ambiguous"] = True
        if len(boxes) > 1 and not seen["ambiguous"]:
            if len(boxes) <= 4:  # plain numbers are quicker
                seen["ambiguous"] = any(iou(a, b) >= AMBIGUOUS_IOU for a, b in itertools.combinations(boxes.tolist(), 2))
            else:
                seen["ambiguous"] = bool((np.triu(overlaps(boxes, boxes)[0], 1) >= AMBIGUOUS_IOU).any())

    def weigh(self, mono: float, current: list[Posture]) -> None:
        still = [p for p in current if p.stationary]
        for p in still:
            if self.near is None or (p.span_s, -p.motion_px) > (self.near.span_s, -self.near.motion_px):
                self.near = p
        self.runs = {p.track: self.runs.get(p.track, p.window_start) for p in still}
        held = [(mono - self.runs[p.track], p) for p in still if p.track not in self.until]
        held = [(d, p) for d, p in held if d >= self.settings.dwell_trigger_s]
        if not held:
            return
        dwell, best = max(held, key=lambda x: (x[0], x[1].span_s))
        if self.state != CANDIDATE:
            self.state = CANDIDATE
            self.chosen = {"track": best.track, "due": mono + self.settings.event_duration_s, "best": best, "dwell": dwell}
        elif self.chosen["track"] == best.track:
            self.chosen |= {"best": best, "dwell": dwell}

    def event(self, mono: float, number: int) -> dict:
        near = self.state != CANDIDATE
        tracks = sorted(self.opened["tracks"], key=track_order)
        stats, dwell = (self.near, 0.0) if near else (self.chosen["best"], self.chosen["dwell"])
        if not near:
            self.until |= dict.fromkeys(tracks, mono + self.settings.cooldown_s)
        multi = self.opened["multi"] or len(tracks) > 1
        return {
            "start_mono": self.opened["mono"], "end_mono": mono, "start_frame": self.opened["frame"], "end_frame": number,
            "primary_track_id": tracks[0] if near else self.chosen["track"], "track_ids": tracks, "n_detections": self.opened["boxes"],
            "multi": multi, "ambiguous": multi or self.opened["ambiguous"], "near_miss": near,
            "stationary_duration_s": stats.span_s, "dwell_duration_s": dwell,
            "confidence": min(0.45, 0.25 + 0.05 * stats.span_s) if near else min(0.7, 0.4 + 0.03 * dwell),
        }


def track_order(track: str) -> tuple[int, str]:
    return (int(track), track) if track.lstrip("-").isdigit() else (0, track)


def apart(x: float, y: float) -> float:
    return math.sqrt(x * x + y * y)


class Trails:
    """The trailing windows of tracks, box by box: each holds what it still spans, and no more."""

    def __init__(self, settings: Settings, sample_rate_fps: float):
        interval = 1.0 / sample_rate_fps if sample_rate_fps > 0 else 0.0
        self.window = settings.stationary_threshold_s
        self.tolerance = min(max(1e-3, 0.15 * self.window, 2.0 * interval), 0.5 * self.window)
        self.recent: dict[str, deque[tuple[float, float, float, float]]] = {}  # time, centre, diagonal

    def take(self, track: str, mono: float, box: Sequence[float]) -> Posture:
        x1, y1, x2, y2 = box
        trail = self.recent.setdefault(track, deque())
        trail.append((mono, (x1 + x2) / 2, (y1 + y2) / 2, apart(max(x2 - x1, 0.0), max(y2 - y1, 0.0))))
        while trail[0][0] < mono - self.window:
            trail.popleft()
        begun, x, y, _ = trail[0]
        motion = max(apart(p[1] - x, p[2] - y) for p in trail)
        diagonals = sorted(p[3] for p in trail)
        span = max(0.0, mono - begun)
        covered = span >= self.window - self.tolerance and len(trail) >= 2
        return Posture(track, span, motion, begun, covered and motion <= max(10.0, 0.2 * diagonals[len(diagonals) // 2]))

    def forget(self, mono: float) -> None:
        """Tracks whose windows would be empty."""
        self.recent = {t: p for t, p in self.recent.items() if p[-1][0] >= mono - self.window}


class Dwelling:
    """A burst's trailing windows and dwell machine as one fold over frames."""

    def __init__(self, settings: Settings, sample_rate_fps: float):
        self.settings, self.rate = settings, sample_rate_fps
        self.machine, self.trails, self.seen = Machine(settings), Trails(settings, sample_rate_fps), 0

    def frame(self, number: int, rows: dict[str, np.ndarray]) -> list[tuple]:
        boxes, mono = rows["boxes"], float(rows["mono_ts"][0])
        here = np.flatnonzero(~np.isnan(boxes[:, 0]))
        current = sorted(((rows["track_id"][i], boxes[i].tolist()) for i in here if rows["track_id"][i] is not None), key=lambda x: track_order(x[0]))
        postures = [self.trails.take(track, mono, box) for track, box in current]
        self.seen += 1
        if self.seen % 256 == 0:
            self.trails.forget(mono)
        return self.rows(self.machine.frame(mono, number, boxes[here], postures, int(rows["n_active"][0])))

    def end(self) -> list[tuple]:
        return self.rows(self.machine.flush())

    @staticmethod
    def rows(events: list[dict]) -> list[tuple]:
        return [tuple(e[f.split()[0]] for f in EVENTS.split(", ")[2:]) for e in events]

    def state(self) -> tuple:
        machine = self.machine
        if machine.last:
            self.trails.forget(machine.last[0])
        return {f.name: getattr(machine, f.name) for f in fields(machine) if f.name != "settings"}, {t: list(p) for t, p in self.trails.recent.items()}

    def resume(self, state: tuple) -> None:
        self.__init__(self.settings, self.rate)
        for name, value in copy.deepcopy(state[0]).items():
            setattr(self.machine, name, value)
        self.trails.recent = {t: deque(p) for t, p in state[1].items()}

    @staticmethod
    def follow(before: tuple | None, carried: list, base: int, start: tuple, end: tuple) -> tuple:
        return before is None or before == start, [], end, [], 0


SUPPRESSIONS = "source string, segment long, track_id string, since_s double, planned_until_s double, ended_s double, ended_by string"


class Suppressing(Dwelling):
    """The same fold; what it tells is when the machine ruled tracks out, and when and why that ended."""

    def __init__(self, settings: Settings, sample_rate_fps: float):
        super().__init__(settings, sample_rate_fps)
        self.since: dict[str, float] = {}

    def frame(self, number: int, rows: dict[str, np.ndarray]) -> list[tuple]:
        before = dict(self.machine.until)
        super().frame(number, rows)
        return self._ended(before, float(rows["mono_ts"][0]))

    def _ended(self, before: dict[str, float], mono: float) -> list[tuple]:
        out = []
        for track, until in before.items():
            if track not in self.machine.until or (mono >= until and self.machine.until[track] != until):
                out.append((track, self.since.pop(track), until, mono, "cooldown" if mono >= until else "cleared"))
        for track in self.machine.until:
            self.since.setdefault(track, mono)
        return out

    def end(self) -> list[tuple]:
        before = dict(self.machine.until)
        super().end()
        return self._ended(before, self.machine.last[0]) if self.machine.last else []

    def state(self) -> tuple:
        return *super().state(), dict(self.since)

    def resume(self, state: tuple) -> None:
        super().resume(state)
        self.since = dict(state[2])


def _folded(frames: DataFrame, detections: DataFrame, make, schema: str, sample_rate_fps: float, max_age: int | None, iou_threshold: float, center_gate: float, chunk: int | None) -> DataFrame:
    age = max(1, round(sample_rate_fps)) if max_age is None else max_age
    rows = located(frames, detections, iou_threshold, age, center_gate, chunk)
    return by_chunk(rows, ["mono_ts", "n_active", "track_id", "x1", "y1", "x2", "y2"], make, schema, chunk or CHUNK)[0].drop("chunk")


def dwell_events(frames: DataFrame, detections: DataFrame, settings: Settings | None = None, sample_rate_fps: float = 1.0, max_age: int | None = None, iou_threshold: float = 0.3, center_gate: float = 0.0, chunk: int | None = None) -> DataFrame:
    """frames: source, frame_idx, mono_ts of every sampled frame; detections (gated): source, frame_idx, det_rank,
    x1..y2, confidence. One row for each event, and for each near miss if asked for. chunk: frames of a burst that one
    task folds."""
    settings = settings or Settings()
    return _folded(frames, detections, lambda: Dwelling(settings, sample_rate_fps), EVENTS, sample_rate_fps, max_age, iou_threshold, center_gate, chunk)


def suppressions(frames: DataFrame, detections: DataFrame, settings: Settings | None = None, sample_rate_fps: float = 1.0, max_age: int | None = None, iou_threshold: float = 0.3, center_gate: float = 0.0, chunk: int | None = None) -> DataFrame:
    """The tracks that events rule out: since when, until when at most, when that ended (the first frame at which it no
    longer held), and why: the cooldown was over, or no track was alive any more or the stream ended (cleared)."""
    settings = settings or Settings()
    return _folded(frames, detections, lambda: Suppressing(settings, sample_rate_fps), SUPPRESSIONS, sample_rate_fps, max_age, iou_threshold, center_gate, chunk)


def event_confidence(dwell_s, span_s, near_miss, known):
    """As a column: by dwell, for near misses by window length; fixed where there are no statistics."""
    sure = F.least(F.lit(0.7), 0.4 + 0.03 * dwell_s)
    close = F.least(F.lit(0.45), 0.25 + 0.05 * span_s)
    return F.when(~known, F.when(near_miss, 0.25).otherwise(0.5)).when(near_miss, close).otherwise(sure)
