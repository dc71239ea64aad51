"""Presence spans of tracks, trailing windows over a track, duplicates across chunks."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import timebase
from ..functions.boxes import Box
from ..lineage import settled
from .intervals import interval_join, islands

MERGE_GAP_S, PAD_S, MIN_LEN_S, MAX_LEN_S = 2.0, 1.0, 0.5, 60.0
SLACK = 1e-9


def raw_spans(samples: DataFrame, keys: list[str], merge_gap_s: float = MERGE_GAP_S, time: str = "time_s") -> DataFrame:
    """Gaps and islands: one row for each run of a track's samples."""
    found = islands(samples, keys, time, merge_gap_s, "span_no")
    return found.groupBy(*keys, "span_no").agg(F.min(time).alias("raw_start_s"), F.max(time).alias("raw_end_s"), F.count("*").alias("n_samples"))


def spans(samples: DataFrame, keys: list[str], fps: float, total_frames: int | Column, merge_gap_s: float = MERGE_GAP_S, pad_s: float = PAD_S, min_len_s: float = MIN_LEN_S, max_len_s: float = MAX_LEN_S, time: str = "time_s") -> DataFrame:
    """Padded runs within the clip, dropped if too short, cut into pieces of max_len_s if longer: keys, span_no, part,
    start_frame, end_frame, start_s, end_s, n_samples (a sample on a cut counts in both pieces)."""
    total = F.lit(total_frames) if isinstance(total_frames, int) else total_frames
    rate, duration = F.lit(float(fps)), total / F.lit(float(fps))
    raw = raw_spans(samples, keys, merge_gap_s, time)
    inside = lambda x: F.greatest(F.lit(0.0), F.least(duration, x))
    raw = raw.withColumns({"a_": inside(F.col("raw_start_s") - pad_s), "b_": inside(F.col("raw_end_s") + pad_s)}).filter((F.col("b_") - F.col("a_") >= min_len_s) & (total > 0))
    if max_len_s > 0:
        # cut points are summed up piece by piece
        steps = F.sequence(F.lit(1), F.ceil((F.col("b_") - F.col("a_")) / max_len_s).cast("int") + 1)
        starts = F.aggregate(steps, F.array("a_"), lambda acc, _: F.concat(acc, F.array(F.element_at(acc, -1) + max_len_s)))
        starts = F.filter(starts, lambda s: s < F.col("b_") - SLACK)
        cuts = F.transform(starts, lambda s: F.struct(s.alias("start_s"), F.least(s + max_len_s, "b_").alias("end_s")))
        whole = F.array(F.struct(F.col("a_").alias("start_s"), F.col("b_").alias("end_s")))
        parts = F.when(F.col("b_") - F.col("a_") > max_len_s, cuts).otherwise(whole)
    else:
        parts = F.array(F.struct(F.col("a_").alias("start_s"), F.col("b_").alias("end_s")))
    out = raw.select(*keys, "span_no", F.posexplode(parts).alias("part", "p_")).select(*keys, "span_no", "part", "p_.start_s", "p_.end_s")
    near = lambda c: timebase.frame_nearest(F.col(c), rate, total)
    out = out.join(_held(samples, keys, merge_gap_s, pad_s, max_len_s, time, duration), [*keys, "span_no", "part"], "left")
    return out.select(*keys, "span_no", "part", near("start_s").alias("start_frame"), F.greatest(near("start_s"), near("end_s")).alias("end_frame"), "start_s", "end_s", F.coalesce("held_", F.lit(0)).cast("int").alias("n_samples"))


def _held(samples: DataFrame, keys: list[str], merge_gap_s: float, pad_s: float, max_len_s: float, time: str, duration: Column) -> DataFrame:
    """keys, span_no, part, held_: how many samples each piece of a span holds. A sample tells its piece from where its
    span begins; next to a cut, within SLACK, it is in both pieces."""
    found = islands(samples, keys, time, merge_gap_s, "span_no")
    begun = F.min(time).over(Window.partitionBy(*keys, "span_no").orderBy(time).rowsBetween(Window.unboundedPreceding, 0))
    t = F.col(time)
    rows = found.withColumn("a_", F.greatest(F.lit(0.0), F.least(duration, begun - pad_s))).filter((t >= F.col("a_") - SLACK) & (t <= duration + SLACK))
    if max_len_s > 0:
        part = F.floor((t - F.col("a_")) / max_len_s).cast("int")
        over = t - F.col("a_") - part * max_len_s  # how far into the piece
        mine = F.array(part, F.when(over <= SLACK, part - 1), F.when(max_len_s - over <= SLACK, part + 1))
        rows = rows.withColumn("part", F.explode(F.filter(mine, lambda k: k >= 0)))
    else:
        rows = rows.withColumn("part", F.lit(0))
    return rows.groupBy(*keys, "span_no", "part").agg(F.count("*").alias("held_"))


def _by_trail(tracks: DataFrame, keys: list[str], seconds: float, time: str, added: str, each: Callable) -> DataFrame:
    """tracks with the columns added, which each gives of a row's trailing window and its own box. Rows come sorted and
    are read once; what is held is the window, a queue of (time, x1, y1, x2, y2) of the last seconds, this row and those of
    the same time included. A row without a time has those without one as its window."""
    extra = StructType.fromDDL(added)
    rows = tracks.drop(*extra.fieldNames())
    schema = StructType([*rows.schema.fields, *extra.fields])
    named = [rows.columns.index(c) for c in (*keys, time, *Box._fields)]
    n = len(keys)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, none = to_arrow_schema(extra), (None,) * len(extra)
        track: tuple | None = None
        window: deque[tuple] = deque()
        left: list = []

        def done(table):
            nonlocal track, window
            columns = [table.column(i).to_pylist() for i in named]
            of, at, own = list(zip(*columns[:n], strict=True)), columns[n], list(zip(*columns[n + 1 :], strict=True))
            out, start, total = [], 0, table.num_rows
            while start < total:
                stop = start + 1
                while stop < total and at[stop] == at[start] and of[stop] == of[start]:
                    stop += 1
                now = at[start]
                if of[start] != track or (window and window[-1][0] is None):
                    track, window = of[start], deque()
                window.extend((now, *own[k]) for k in range(start, stop) if None not in own[k])
                while now is not None and window and window[0][0] < now - seconds:
                    window.popleft()
                out += [none if None in own[k] else each(window, own[k]) for k in range(start, stop)]
                start = stop
            new = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)]
            whole = pa.Table.from_arrays([*table.columns, *new], names=[*table.column_names, *kinds.names])
            return whole.combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            left.append(batch)
            # The last rows of one time wait for more of it.
            same = [batch.column(i).slice(0, 1).to_pylist()[0] == batch.column(i).slice(batch.num_rows - 1, 1).to_pylist()[0] for i in named[: n + 1]]
            if all(same):
                continue
            table = pa.Table.from_batches(left)
            ends = [table.column(i).to_pylist() for i in named[: n + 1]]
            stop = table.num_rows - 1
            while stop and all(c[stop - 1] == c[-1] for c in ends):
                stop -= 1
            yield from done(table.slice(0, stop)) if stop else ()
            left = table.slice(stop).to_batches()
        if left:
            yield from done(pa.Table.from_batches(left))

    return rows.repartition(*keys).sortWithinPartitions(*keys, time).mapInArrow(run, schema)


def _middle(box: tuple) -> tuple[float, float]:
    return (box[0] + box[2]) / 2, (box[1] + box[3]) / 2


def _apart(x: float, y: float) -> float:
    return math.sqrt(x * x + y * y)


def _diagonal(box: tuple) -> float:
    return _apart(max(box[2] - box[0], 0.0), max(box[3] - box[1], 0.0))


def _area(box: tuple) -> float:
    return max(box[2] - box[0], 0.0) * max(box[3] - box[1], 0.0)


def stationarity(tracks: DataFrame, keys: list[str], threshold_s: float, sample_rate_fps: float, time: str = "mono_ts") -> DataFrame:
    """For each box of a track: window start, end and span, greatest centre distance from the window's first box, the
    allowed motion (10 pixels or a fifth of the upper median diagonal), and whether the track stands still."""
    interval = 1.0 / sample_rate_fps if sample_rate_fps > 0 else 0.0
    tolerance = min(max(1e-3, 0.15 * threshold_s, 2.0 * interval), 0.5 * threshold_s)

    def each(window: deque, box: tuple) -> tuple:
        start, end, n = window[0][0], window[-1][0], len(window)
        x, y = _middle(window[0][1:])
        motion = max(_apart(p - x, q - y) for p, q in (_middle(w[1:]) for w in window))
        diagonals = sorted(_diagonal(w[1:]) for w in window)
        allowed = max(10.0, 0.2 * diagonals[n // 2])
        span = None if start is None else max(end - start, 0.0)
        still = span is not None and span >= threshold_s - tolerance and n >= 2 and motion <= allowed
        return start, end, n, span, motion, allowed, still

    added = "window_start double, window_end double, n_recent int, span_s double, motion_px double, allowed_px double, stationary boolean"
    return _by_trail(tracks, keys, threshold_s, time, added, each)


def steadied(tracks: DataFrame, keys: list[str], window_s: float, max_shift: float = 1.0, max_growth: float = 4.0, time: str = "mono_ts") -> DataFrame:
    """Adds u1..: the union with the track's boxes of the last window_s whose centres are within max_shift diagonals;
    the raw box where that would be over max_growth times its area."""
    names = ("ux1", "uy1", "ux2", "uy2")
    if window_s <= 0:
        return tracks.withColumns(dict(zip(names, Box.of(), strict=True)))

    def each(window: deque, box: tuple) -> tuple:
        (x, y), reach = _middle(box), _diagonal(box)
        near = [box]
        for _, *b in window:
            p, q = _middle(b)
            if reach <= 0 or _apart(p - x, q - y) <= max_shift * reach:
                near.append(b)
        grown = min(b[0] for b in near), min(b[1] for b in near), max(b[2] for b in near), max(b[3] for b in near)
        return box if _area(box) > 0 and _area(grown) > max_growth * _area(box) else grown

    return _by_trail(tracks, keys, window_s, time, ", ".join(f"{n} double" for n in names), each)


def dwell_runs(still: DataFrame, keys: list[str], time: str = "mono_ts") -> DataFrame:
    """Runs of stationary rows of a track: the run counts from the trailing window's start, so dwell_s of a row is its
    time less the window start of the run's first row."""
    w = Window.partitionBy(*keys).orderBy(time)
    begins = F.col("stationary") & ~F.coalesce(F.lag("stationary").over(w), F.lit(False))
    marked = still.withColumn("run", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("stationary")
    since = F.first("window_start").over(Window.partitionBy(*keys, "run").orderBy(time).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("dwell_s", F.col(time) - since)


def without_chunk_repeats(found: DataFrame, keys: list[str], overlap_s: float, chunk_s: float, min_iou: float = 0.5, chunk: str = "chunk_start_s", span: str = "span_id") -> DataFrame:
    """Drops spans of a chunk's head that repeat a span kept in an earlier chunk. start_s and end_s count from the
    chunk's start (chunk: seconds). What was dropped can't drop others, so spans are settled in chunk order: a span's
    only rivals are kept spans that reach its head, and only spans in two heads in a row make a chain; each round
    settles the spans all of whose rivals are settled."""
    if overlap_s <= 0:
        return found
    rows = found.withColumns({"s_": F.col(chunk) + F.col("start_s"), "e_": F.col(chunk) + F.col("end_s")})
    head = (F.col("e_") > F.col(chunk)) & (F.col("s_") < F.col(chunk) + overlap_s)
    late = rows.filter(head).select(*keys, F.col(span).alias("late"), F.col(chunk).alias("late_chunk"), F.col("s_").alias("ls"), F.col("e_").alias("le"))
    early = rows.select(*keys, F.col(span).alias("early"), F.col(chunk).alias("early_chunk"), F.col("s_").alias("es"), F.col("e_").alias("ee"))
    pairs = interval_join(late, early, keys, ("ls", "le"), ("es", "ee"), chunk_s)
    reaches = (F.col("ee") > F.col("late_chunk")) & (F.col("es") < F.col("late_chunk") + overlap_s)
    links = pairs.filter((F.col("early_chunk") < F.col("late_chunk")) & reaches & (timebase.time_iou(F.col("ls"), F.col("le"), F.col("es"), F.col("ee")) >= min_iou)).select("late", "early").distinct()
    return found.join(overruled(links).select(F.col("node").alias(span)), span, "left_anti")


def overruled(links: DataFrame) -> DataFrame:
    """Of links (late, early; no circles): node, each late that an early which is not overruled itself overrules.

    Who has one rival is what the rival is not; so chains of such are followed by pointers that double their reach, with
    whether the end's fate or its opposite is theirs. Those with several rivals wait until one stands or all are
    overruled, and a rival that hangs on a chain counts by the chain's end. Rounds grow with the logarithm of a chain's
    length, and with how many such knots follow one another."""
    # A rival counts if it stands or, with turned, if it is overruled.
    open_ = settled(links.select("late", "early").distinct().withColumn("turned", F.lit(False)))
    ends = open_.select(F.col("early").alias("node")).distinct().join(open_.select(F.col("late").alias("node")), "node", "left_anti")
    known = settled(ends.withColumn("stands", F.lit(True)))
    fates = known
    while not open_.isEmpty():
        # What is known of rivals: one that counts overrules; one that does not is no rival any more.
        seen = open_.join(known.withColumnRenamed("node", "early"), "early", "left").withColumn("counts", F.col("stands") != F.col("turned"))
        each = seen.groupBy("late").agg(F.bool_or(F.coalesce("counts", F.lit(False))).alias("lost"), F.count_if(F.col("counts").isNull()).alias("rivals"))
        each = settled(each)
        known = settled(each.filter("lost or rivals = 0").select(F.col("late").alias("node"), (~F.col("lost")).alias("stands")))
        fates = fates.unionByName(known)
        rest = seen.filter(F.col("counts").isNull()).join(each.filter("not lost and rivals > 0").select("late", "rivals"), "late")
        open_ = settled(rest.select("late", "early", "turned", "rivals"))
        if open_.isEmpty():
            break
        # One rival: the fate is the rival's, turned round unless it is turned already.
        ends_at = settled(open_.filter("rivals = 1").select(F.col("late").alias("node"), F.col("early").alias("end"), (~F.col("turned")).alias("other")))
        while True:
            onward = ends_at.select(F.col("node").alias("end"), F.col("end").alias("next"), F.col("other").alias("more"))
            step = settled(ends_at.join(onward, "end", "left"))
            if step.filter("next is not null").isEmpty():
                break
            ends_at = settled(step.select("node", F.coalesce("next", "end").alias("end"), (F.col("other") != F.coalesce("more", F.lit(False))).alias("other")))
        via = ends_at.select(F.col("node").alias("early"), "end", "other")
        knots = open_.filter("rivals > 1").join(via, "early", "left")
        knots = knots.select("late", F.coalesce("end", "early").alias("early"), (F.col("turned") != F.coalesce("other", F.lit(False))).alias("turned"))
        chained = ends_at.select(F.col("node").alias("late"), F.col("end").alias("early"), (~F.col("other")).alias("turned"))
        open_ = settled(knots.unionByName(chained).distinct())
    return fates.filter("not stands").select("node")
