"""Greedy box tracking, in parallel over bursts of activity.

A tracker forgets everything once no track is alive, so a stretch of max_age + 1 sampled frames without a box is an
exact cut: each burst between cuts is tracked by itself, and its track numbers are shifted by the births before it.
What the trackers say is kept as a checkpoint, so that they run once for all that is read from it. A burst is cut into
chunks that are tracked in parallel (see chunked); trackers of the caller's own run over whole bursts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..lineage import settled

TRACKED = "source string, segment long, frame_idx long, det_rank int, track_no int, births int, n_active int"
KEYS = ["source", "segment"]
#: Results are handed on in batches of about so many rows.
OUT_ROWS = 10_000


@dataclass
class Tracker:
    """One source's tracks. boxes: rows x1, y1, x2, y2; tracks in the order of their birth."""

    iou_threshold: float = 0.3
    max_age: int = 15
    min_confidence: float = 0.0
    center_gate: float = 0.0
    numbers: list[int] = field(default_factory=list)
    last: list[list[float]] = field(default_factory=list)
    missed: list[int] = field(default_factory=list)
    born: int = 0
    #: Whether the tracks' order has decided who takes a box.
    tied: bool = False

    def update(self, boxes: np.ndarray, confidence: np.ndarray) -> np.ndarray:
        """Takes one frame's boxes, empty or not; each box's track number, -1 if it is too unsure."""
        out = np.full(len(boxes), -1)
        sure = confidence.tolist()
        order = [i for i in sorted(range(len(sure)), key=lambda i: -sure[i]) if sure[i] >= self.min_confidence]
        pairs = []
        if order and self.last and self.center_gate <= 0 and len(order) * len(self.last) <= 16:
            new = boxes[order].tolist()
            pairs = [(-s, 0.0, t, b) for t, old in enumerate(self.last) for b, box in enumerate(new) if (s := iou(old, box)) >= self.iou_threshold]
        elif order and self.last:
            shared, apart = overlaps(np.array(self.last), boxes[order])
            near = (apart <= self.center_gate) if self.center_gate > 0 else np.zeros_like(shared, bool)
            far = apart if self.center_gate > 0 else np.zeros_like(apart)
            pairs = [(-shared[t, b], far[t, b], t, b) for t, b in zip(*np.nonzero((shared >= self.iou_threshold) | near), strict=True)]
        self.tied = self.tied or _contested(pairs)
        taken, used = {}, set()
        for _, _, t, b in sorted(pairs):  # ties: older track, then surer box
            if t not in taken and b not in used:
                taken[t] = b
                used.add(b)
        alive = []
        for t in range(len(self.last)):
            if t in taken:
                self.last[t], self.missed[t] = boxes[order[taken[t]]].tolist(), 0
                out[order[taken[t]]] = self.numbers[t]
            else:
                self.missed[t] += 1
            if self.missed[t] <= self.max_age:
                alive.append(t)
        self.numbers, self.last, self.missed = ([x[t] for t in alive] for x in (self.numbers, self.last, self.missed))
        for b, i in enumerate(order):
            if b not in used:
                self.born += 1
                self.numbers.append(self.born), self.last.append(boxes[i].tolist()), self.missed.append(0)
                out[i] = self.born
        return out


def _contested(pairs: list[tuple]) -> bool:
    """Whether two tracks are as near to one box."""
    return len(pairs) > 1 and len({(p[0], p[1], p[3]) for p in pairs}) < len(pairs)


def iou(a, b) -> float:
    """Of two boxes, in the order of operations of overlaps: for a few boxes it is quicker."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    whole = max(a[2] - a[0], 0) * max(a[3] - a[1], 0) + max(b[2] - b[0], 0) * max(b[3] - b[1], 0) - w * h
    return w * h / whole if whole > 0 else 0.0


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """IoU of all pairs, and centre distance in diagonals of a (infinite where a has none)."""
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    shared = np.maximum(w, 0) * np.maximum(h, 0)
    size = lambda x: np.maximum(x[:, 2:] - x[:, :2], 0)
    whole = size(a).prod(axis=1)[:, None] + size(b).prod(axis=1)[None, :] - shared
    iou = np.divide(shared, whole, out=np.zeros_like(shared), where=(shared > 0) & (whole > 0))
    middle = lambda x: (x[:, :2] + x[:, 2:]) / 2
    distance = np.hypot(*np.moveaxis(middle(a)[:, None] - middle(b)[None, :], -1, 0))
    diagonal = np.hypot(*size(a).T)[:, None]
    return iou, np.divide(distance, diagonal, out=np.full_like(distance, np.inf), where=diagonal > 0)


#: Frames of a source that one task numbers.
STRETCH = 1 << 17


def segmented(frames: DataFrame, detections: DataFrame, max_age: int, min_confidence: float = 0.0, stretch: int = STRETCH) -> DataFrame:
    """frames (source, frame_idx, ...) with segment, the number of its first frame in the source; each segment has its
    frames and up to max_age + 1 empty ones after, and frames between segments are left out.

    A source's frames are dealt to stretches. What a stretch needs of those before it (how many frames they have, their
    last frame with a box, where the last segment began) is one row for each, so a long history is never in one task."""
    sure = detections.filter(F.col("confidence") >= min_confidence).select("source", "frame_idx").distinct().withColumn("has_", F.lit(1))
    part = ["source", "stretch_"]
    order = Window.partitionBy(*part).orderBy("frame_idx")
    past = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("source").orderBy("stretch_").rowsBetween(Window.unboundedPreceding, -1)

    def carried(rows: DataFrame, known, over, name: str) -> DataFrame:
        """rows with name: what known sums up to over all stretches before."""
        each = rows.groupBy(*part).agg(known.alias("k_")).select(*part, over(F.col("k_")).over(earlier).alias(name))
        return rows.join(each, part)

    rows = frames.join(sure, ["source", "frame_idx"], "left").withColumn("stretch_", F.floor(F.col("frame_idx") / stretch))
    rows = carried(rows, F.count("*"), F.sum, "before_").withColumn("n_", F.row_number().over(order) + F.coalesce("before_", F.lit(0)))
    here = F.when(F.col("has_").isNotNull(), F.col("n_"))
    rows = carried(rows, F.max(here), F.max, "last_").withColumn("seen_", F.coalesce(F.last(here, True).over(past), "last_"))
    before = F.coalesce(F.lag("seen_").over(order), "last_")
    new = F.col("has_").isNotNull() & (before.isNull() | (F.col("n_") - before >= max_age + 2))
    rows = rows.withColumn("begun_", F.when(new, F.col("n_")))
    rows = carried(rows, F.max("begun_"), F.max, "open_").withColumn("segment", F.coalesce(F.last("begun_", True).over(past), "open_").cast("long"))
    return rows.filter(F.col("segment").isNotNull() & (F.col("n_") - F.col("seen_") <= max_age + 1)).select(*frames.columns, "segment")


def by_burst(rows: DataFrame, columns: list[str], state, schema: str) -> DataFrame:
    """Folds each burst's frames in their order, in one pass over sorted rows: neither a burst nor its results are ever
    held whole. rows: source, segment, frame_idx, det_rank and columns (numbers, or texts). state() makes a burst's
    state with frame(frame_idx, rows as a dict of arrays, x1..y2 also together as boxes) and end(), both giving tuples that follow source, segment."""
    names = ["source", "segment", "frame_idx", "det_rank", *columns]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much to do: never coalesced
    dealt = rows.select(*names).repartition(parts, *KEYS).sortWithinPartitions(*KEYS, "frame_idx", "det_rank")
    return dealt.mapInArrow(in_order(names, state, StructType.fromDDL(schema)), schema)


def in_order(names: list[str], state, schema: StructType, keys: int = 2):
    """For mapInArrow: folds sorted rows, of which the first columns (so many) tell what belongs together."""

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        burst, now, frame, parts, out = None, None, None, [], []

        def settle():
            """The frame whose rows are all read."""
            held = parts[0] if len(parts) == 1 else {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}
            return [(*burst, *x) for x in now.frame(frame, held)]

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

        for batch in batches:
            if not batch.num_rows:
                continue
            arrays = {n: batch.column(i + keys + 1).to_numpy(zero_copy_only=False) for i, n in enumerate(names[keys + 1 :])}
            if "x1" in arrays:
                arrays["boxes"] = np.stack([arrays[c].astype(float) for c in ("x1", "y1", "x2", "y2")], axis=1)
            ids = list(zip(*(batch.column(i).to_pylist() for i in range(keys + 1)), strict=True))
            edges = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            for a, b in zip(edges, edges[1:], strict=False):
                key, number = ids[a][:keys], ids[a][keys]
                if parts and (key != burst or number != frame):
                    out += settle()
                    parts = []
                if key != burst:
                    if now is not None:
                        out += [(*burst, *x) for x in now.end()]
                    burst, now = key, state()
                frame = number
                parts.append({n: x[a:b] for n, x in arrays.items()})
                if len(out) >= OUT_ROWS:
                    yield pack(out)
                    out = []
        if parts:
            out += settle()
            out += [(*burst, *x) for x in now.end()]
        if out:
            yield pack(out)

    return run


_in_order = in_order


class Tracking:
    """A burst's tracker as a fold over frames. What it says of tracks counts from its beginning: those that were there
    are 1, 2, ..., and those born later follow."""

    def __init__(self, make):
        self.make = make
        self.resume(([], False))

    def frame(self, number: int, rows: dict[str, np.ndarray]) -> list[tuple]:
        confidence = rows["confidence"].astype(float)
        real = ~np.isnan(confidence)
        numbers = self.tracker.update(rows["boxes"][real], confidence[real])
        born, active = self.tracker.born - self.given, len(self.tracker.numbers)
        out = [(number, int(r), int(n), born, active) for r, n in zip(rows["det_rank"][real], numbers, strict=True) if n >= 0]
        return [*out, (number, -1, 0, born, active)]  # the frame itself

    def end(self) -> list[tuple]:
        return []

    def state(self) -> tuple:
        """Tracks as (last box, frames missed, number), by birth; whether their order has mattered; births."""
        t = self.tracker
        return [(tuple(map(float, b)), m, n) for b, m, n in zip(t.last, t.missed, t.numbers, strict=True)], t.tied, t.born - self.given

    def resume(self, state: tuple) -> None:
        tracks = state[0]
        self.tracker = self.make()
        self.given = len(tracks)
        if tracks:
            self.tracker.last, self.tracker.missed = [list(b) for b, _, _ in tracks], [m for _, m, _ in tracks]
            self.tracker.numbers, self.tracker.born = list(range(1, len(tracks) + 1)), len(tracks)

    @staticmethod
    def follow(before: tuple | None, carried: list[int], base: int, start: tuple, end: tuple) -> tuple:
        """carried: the numbers of before's tracks within the burst; base: births until then. Tracks' order only decides
        between tracks that are as near to one box, so it may differ where that did not happen."""
        have = [(b, m) for b, m, _ in start[0]]
        place: list[int] | None = list(range(len(have)))
        if before is not None:
            want = [(b, m) for b, m, _ in before[0]]
            if have != want:
                other = end[1] or len(set(want)) < len(want) or sorted(have) != sorted(want)
                place = None if other else [want.index(h) for h in have]
        mine = list(range(-len(have), 0)) if place is None or before is None else [carried[p] for p in place]
        numbers = [mine[n - 1] if n <= len(mine) else base + n - len(mine) for _, _, n in end[0]]
        order = sorted(range(len(numbers)), key=numbers.__getitem__)  # by birth
        return place is not None, mine, ([end[0][i] for i in order], *end[1:]), [numbers[i] for i in order], base + end[2]



LOCATED = TRACKED + ", mono_ts double, x1 double, y1 double, x2 double, y2 double"


class Located(Tracking):
    """The same, with each frame's time and boxes, for folds that go on from there."""

    def frame(self, number: int, rows: dict[str, np.ndarray]) -> list[tuple]:
        mono, boxes = float(rows["mono_ts"][0]), rows["boxes"].tolist()
        at = dict(zip(rows["det_rank"].tolist(), boxes, strict=True))
        return [(*x, mono, *(at[x[1]] if x[1] >= 0 else [None] * 4)) for x in super().frame(number, rows)]


def _numbered(frames: DataFrame, detections: DataFrame, fold: type[Tracking], schema: str, iou_threshold: float, max_age: int, min_confidence: float, center_gate: float, make, chunk: int | None) -> DataFrame:
    """What the fold tells of each box, and of each frame (det_rank -1), with chunk and track_id (by birth within the
    source, from 1)."""
    from .chunked import CHUNK, by_chunk

    parts = segmented(frames, detections, max_age, min_confidence)
    boxes = detections.select("source", "frame_idx", "det_rank", "x1", "y1", "x2", "y2", "confidence")
    joined = parts.join(boxes, ["source", "frame_idx"], "left")
    columns = [*(c for c in frames.columns if c not in ("source", "frame_idx")), "x1", "y1", "x2", "y2", "confidence"]
    if make is None:
        raw, links = by_chunk(joined, columns, lambda: fold(lambda: Tracker(iou_threshold, max_age, min_confidence, center_gate)), schema, chunk or CHUNK, ends=False)
        links = links.select(*KEYS, "chunk", "carried", "base", "total")
    else:
        raw = settled(by_burst(joined, columns, lambda: fold(make), schema)).withColumn("chunk", F.lit(0).cast("long"))
        links = raw.groupBy(*KEYS, "chunk").agg(F.max("births").alias("total")).withColumns({"carried": F.array().cast("array<long>"), "base": F.lit(0).cast("long")})
    # Numbers within the burst; then after all births of the source's bursts before it.
    births = links.groupBy(*KEYS).agg(F.max("total").alias("b_"))
    before = Window.partitionBy("source").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    births = births.select(*KEYS, F.coalesce(F.sum("b_").over(before), F.lit(0)).alias("before_"))
    numbered = raw.join(links.join(births, KEYS).drop("total"), [*KEYS, "chunk"])
    given = F.size("carried")
    number = F.when(F.col("track_no") <= given, F.try_element_at("carried", F.col("track_no"))).otherwise(F.col("base") + F.col("track_no") - given)
    track = F.when(F.col("det_rank") >= 0, (number + F.col("before_")).cast("string"))
    return numbered.withColumn("track_id", track).drop("carried", "base", "before_", "track_no", "births")


def located(frames: DataFrame, detections: DataFrame, iou_threshold: float = 0.3, max_age: int = 15, center_gate: float = 0.0, chunk: int | None = None) -> DataFrame:
    """source, segment, frame_idx, det_rank, n_active, mono_ts, x1..y2, track_id: a row for each box, and for each frame
    one without (det_rank -1). frames: source, frame_idx, mono_ts."""
    return _numbered(frames.select("source", "frame_idx", "mono_ts"), detections, Located, LOCATED, iou_threshold, max_age, 0.0, center_gate, None, chunk).drop("chunk")


def tracked(frames: DataFrame, detections: DataFrame, iou_threshold: float = 0.3, max_age: int = 15, min_confidence: float = 0.0, center_gate: float = 0.0, make=None, chunk: int | None = None) -> tuple[DataFrame, DataFrame]:
    """frames: source, frame_idx of every sampled frame. detections: source, frame_idx, det_rank (int, surest first),
    x1..y2, confidence, and more. Returns detections with segment and track_id (by birth within the source, from 1),
    and frames with segment and n_active. make builds another tracker with the same update(); chunk: frames of a burst
    that one task tracks."""
    numbered = _numbered(frames.select("source", "frame_idx"), detections, Tracking, TRACKED, iou_threshold, max_age, min_confidence, center_gate, make, chunk)
    ids = numbered.filter("det_rank >= 0").select(*KEYS, "frame_idx", "det_rank", "track_id")
    return detections.join(ids, ["source", "frame_idx", "det_rank"]), numbered.filter("det_rank < 0").select(*KEYS, "frame_idx", "n_active")
