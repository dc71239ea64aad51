"""Frame numbers, seconds, clocks, time stamps in metadata and file names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_FPS, SLACK, PTS_SLACK = 30.0, 1e-9, 1e-4


def half_even(x: Column) -> Column:
    return F.bround(x, 0)


def whole(x: Column) -> Column:
    return x.cast("long")


def clamp_frame(frame: Column, frame_count: Column) -> Column:
    return F.greatest(F.lit(0), F.least(frame, frame_count - 1))


def usable_fps(fps: Column) -> Column:
    return F.when(fps > 0, fps).otherwise(F.lit(DEFAULT_FPS))


def frame_seconds(frame: Column, fps: Column, frame_count: Column, times: Column | None = None) -> Column:
    """At a constant rate, or from the array of frame times where that is not null."""
    at = clamp_frame(frame, frame_count)
    steady = at / usable_fps(fps)
    return steady if times is None else F.when(times.isNull(), steady).otherwise(F.get(times, at.cast("int")))


def clip_duration(fps: Column, frame_count: Column, times: Column) -> Column:
    """The last gap is repeated at the end of a clip with frame times; one frame lasts 1/fps."""
    n, last = F.size(times), F.element_at(times, -1)
    gap = F.greatest(F.lit(0.0), last - F.get(times, n - 2))
    return F.when(times.isNull(), frame_count / usable_fps(fps)).when(n == 0, 0.0).when(n == 1, last + 1.0 / usable_fps(fps)).otherwise(last + gap)


def _ceil_with_slack(x: Column) -> Column:
    down = whole(x)
    return F.when(F.abs(x - down) < SLACK, down).otherwise(down + 1)


def frame_floor(seconds: Column, fps: Column, frame_count: Column, times: Column | None = None) -> Column:
    s = F.greatest(seconds, F.lit(0.0))
    found = whole(s * usable_fps(fps))
    if times is not None:
        found = F.when(times.isNull(), found).otherwise(F.size(F.filter(times, lambda t: t <= s)) - 1)
    return F.when(frame_count <= 0, 0).otherwise(clamp_frame(found, frame_count))


def frame_ceil(seconds: Column, fps: Column, frame_count: Column, times: Column | None = None) -> Column:
    s = F.greatest(seconds, F.lit(0.0))
    found = _ceil_with_slack(s * usable_fps(fps))
    if times is not None:
        found = F.when(times.isNull(), found).otherwise(F.size(F.filter(times, lambda t: t < s)))
    return F.when(frame_count <= 0, 0).otherwise(clamp_frame(found, frame_count))


def frame_nearest(seconds: Column, fps: Column, frame_count: Column, times: Column | None = None) -> Column:
    """Half-even at a constant rate; of two frame times as near, the earlier."""
    s = F.greatest(seconds, F.lit(0.0))
    found = whole(half_even(s * usable_fps(fps)))
    if times is not None:
        right = F.size(F.filter(times, lambda t: t < s))
        nearer = F.abs(F.get(times, right - 1) - s) <= F.abs(F.get(times, right) - s)
        of_times = F.when(right <= 0, 0).when(right >= F.size(times), F.size(times) - 1).when(nearer, right - 1).otherwise(right)
        found = F.when(times.isNull(), found).otherwise(of_times)
    return F.when(frame_count <= 0, 0).otherwise(clamp_frame(found, frame_count))


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value computed once: an expression that a lambda refers to is else computed again for each element."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _normalised(times: Column) -> Column:
    bad = F.exists(times, lambda t: t.isNull() | F.isnan(t) | (F.abs(t) == float("inf")))
    message = F.lit("frame times must be finite and must not fall")

    def checked(based: Column) -> Column:
        falls = F.exists(F.sequence(F.lit(1), F.greatest(F.size(based) - 1, F.lit(1))), lambda i: F.coalesce(F.get(based, i) + SLACK < F.get(based, i - 1), F.lit(False)))
        return F.when(F.size(times) == 0, based).when(bad | falls, F.raise_error(message).cast("array<double>")).otherwise(based)

    return bound(F.transform(times, lambda t: F.round(t - F.get(times, F.lit(0)), 9)), checked)


def normalised_times(times: Column) -> Column:
    """From 0, rounded to nine places; times that are not finite or that fall are an error."""
    return bound(times, _normalised)


def uneven_times(times: Column, fps: Column) -> Column:
    """Normalised frame times where any is off the constant rate by more than 1e-4 s, else null."""

    def checked(fine: Column) -> Column:
        off = F.exists(F.transform(fine, lambda t, i: F.abs(t - i / fps)), lambda d: d > PTS_SLACK)
        return F.when((fps <= 0) | off, fine)

    return F.when(F.size(times) > 0, bound(normalised_times(times), checked))


def clip_times(times: Column, start: Column, end: Column) -> Column:
    """The frame times of a part of a source, from 0; null where the part isn't wholly there."""

    def of(times: Column) -> Column:
        part = F.slice(times, start + 1, F.greatest(end - start + 1, F.lit(0)))
        inside = times.isNotNull() & (start >= 0) & (end >= start) & (end < F.size(times))
        return F.when(inside, F.transform(part, lambda t: F.round(t - F.get(times, start), 9)))

    return bound(times, of)


def thinned(items: Column, cap: Column | int) -> Column:
    """At most cap of a sorted array, evenly by half-even index; all if cap <= 0."""
    cap = F.lit(cap) if isinstance(cap, int) else cap
    last = F.size(items) - 1
    picks = F.transform(F.sequence(F.lit(0), F.greatest(cap - 1, F.lit(0))), lambda i: F.get(items, half_even(i * last / F.greatest(cap - 1, F.lit(1))).cast("int")))
    return F.when((cap <= 0) | (F.size(items) <= cap), items).when(cap == 1, F.slice(items, 1, 1)).otherwise(F.array_distinct(picks))


def evenly(items: Column, cap: int) -> Column:
    """At most cap items at index int(i * n / cap); all if cap <= 0."""
    n = F.size(items)
    return F.when((F.lit(cap) <= 0) | (n <= cap), items).otherwise(F.transform(F.sequence(F.lit(0), F.lit(max(cap, 1) - 1)), lambda i: F.get(items, F.floor(i * n / F.lit(max(cap, 1))).cast("int"))))


def stride_frames(start: Column, end: Column, stride_s: Column, fps: Column, frame_count: Column, times: Column | None = None, cap: int = 0) -> Column:
    """Frames of start..end a stride apart: every so many frames, or the next frame at or after each target time."""
    fps = usable_fps(fps)
    stride = F.when(stride_s > 0, stride_s).otherwise(1.0 / fps)
    a, b = clamp_frame(start, frame_count).cast("int"), clamp_frame(end, frame_count).cast("int")
    step = F.greatest(F.lit(1), half_even(stride * fps).cast("int"))
    found = F.sequence(a, F.greatest(a, b), step)
    if times is not None:
        first, last = F.get(times, a), F.get(times, b)
        targets = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil((last - first) / stride).cast("int") + 1))
        # targets are summed up step by step, so that rounding is that of a running sum
        sums = F.aggregate(targets, F.array(first), lambda acc, _: F.concat(acc, F.array(F.element_at(acc, -1) + stride)))
        ahead = F.filter(F.slice(sums, 2, F.size(sums)), lambda t: t <= last + SLACK)
        frames = F.transform(ahead, lambda t: F.least(F.size(F.filter(times, lambda x: x < t)), F.size(times) - 1))
        by_time = F.array_distinct(F.concat(F.array(a), F.filter(frames, lambda f: (f >= a) & (f <= b))))
        found = F.when(times.isNull(), found).otherwise(by_time)
    return F.when(end < start, F.array().cast("array<int>")).otherwise(thinned(found, cap))


def sample_every(fps: Column, rate: Column) -> Column:
    return F.greatest(F.lit(1), half_even(fps / rate).cast("int"))


def parsed_utc(value: Column) -> Column:
    """An ISO-8601 text as a UTC time stamp: Z or an offset or neither (UTC); others are null."""
    text = F.regexp_replace(value, "Z$", "+00:00")
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([+-]\d{2}:?\d{2})?)?$")
    return F.when(iso, F.try_to_timestamp(text))


def _offset_seconds(sign: Column, hours: Column, minutes: Column) -> Column:
    return F.when(sign == "-", -1).otherwise(1) * (hours.cast("int") * 3600 + F.coalesce(F.nullif(minutes, F.lit("")).cast("int"), F.lit(0)) * 60)


def _utc(year, month, day, hour, minute, second, offset) -> Column:
    local = F.try_make_timestamp(*(c.cast("int") for c in (year, month, day, hour, minute)), second.cast("decimal(8,6)"))
    return F.timestamp_micros(F.unix_micros(local) - offset.cast("long") * 1_000_000)


#: How exports and recordings write the time in file names.
EXPORT_NAME = r"(\d{1,2})-(\d{1,2})-(\d{4}), (\d{1,2})\.(\d{2})\.(\d{2}) GMT([+-])(\d{1,2})(?::?(\d{2}))?"
ISO_NAME = r"(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(Z|[+-]\d{2}:?\d{2})?"


def export_name_time(name: Column) -> Column:
    """`M-D-YYYY, H.MM.SS GMT+H[:MM]` in a file name; impossible dates are null."""
    g = lambda i: F.regexp_extract(name, EXPORT_NAME, i)
    offset = _offset_seconds(g(7), g(8), g(9))
    return F.when(name.rlike(EXPORT_NAME), F.when(F.abs(offset) < 86400, _utc(*(F.nullif(g(i), F.lit("")) for i in (3, 1, 2, 4, 5, 6)), offset)))


def iso_name_time(name: Column) -> Column:
    """`YYYYMMDDTHHMMSS` with Z, an offset or neither (UTC) in a file name."""
    g = lambda i: F.regexp_extract(name, ISO_NAME, i)
    zone = F.regexp_replace(g(7), ":", "")
    offset = F.when(zone.isin("", "Z"), 0).otherwise(_offset_seconds(F.substring(zone, 1, 1), F.nullif(F.substring(zone, 2, 2), F.lit("")), F.substring(zone, 4, 2)))
    return F.when(name.rlike(ISO_NAME), _utc(*(F.nullif(g(i), F.lit("")) for i in range(1, 7)), offset))


def time_anchor(name: Column, modified: Column, override: Column | None = None) -> Column:
    """struct(ts, basis): the first of an override, the file name, the file's time and now."""
    of = lambda ts, basis: F.when(ts.isNotNull(), F.struct(ts.alias("ts"), F.lit(basis).alias("basis")))
    given = override if override is not None else F.lit(None).cast("timestamp")
    return F.coalesce(of(given, "config"), of(F.coalesce(export_name_time(name), iso_name_time(name)), "filename"), of(modified, "mtime"), of(F.current_timestamp(), "runtime_now"))


def frame_clocks(frame: Column, fps: Column, mono_base: Column, anchor: Column, source_time: Column | None = None) -> Column:
    """struct(mono_ts, wall_ts)."""
    seconds = frame / usable_fps(fps)
    wall = F.coalesce(source_time, seconds) if source_time is not None else seconds
    return F.struct((mono_base + seconds).alias("mono_ts"), F.timestamp_micros(F.unix_micros(anchor) + half_even(wall * 1e6).cast("long")).alias("wall_ts"))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def source_offsets(start: Column, end: Column, anchor: Column, basis: Column, live: Column) -> Column:
    """struct(source_start_s, source_end_s): null for live sources and where the anchor is only the time of the run."""
    known = ~live & (basis != "runtime_now")
    return F.struct(F.when(known, seconds_between(anchor, start)).alias("source_start_s"), F.when(known, seconds_between(anchor, end)).alias("source_end_s"))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 < b1) & (b0 < a1)


def time_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    shared = F.least(a1, b1) - F.greatest(a0, b0)
    whole_time = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when((shared > 0) & (whole_time > 0), shared / whole_time).otherwise(0.0)


def chunk_windows(start: Column, end: Column, chunk_s: int, overlap_s: int) -> Column:
    """Array of struct(start, end): windows of chunk_s that reach overlap_s into the next; empty if end <= start."""
    step = F.expr(f"interval {int(chunk_s)} seconds")
    starts = F.filter(F.sequence(start, F.greatest(start, end), step), lambda t: t < end)
    return F.transform(starts, lambda t: F.struct(t.alias("start"), F.least(t + F.expr(f"interval {int(chunk_s + overlap_s)} seconds"), end).alias("end")))
