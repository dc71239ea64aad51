"""Queries over clocks, frame numbers, file names and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, timebase
from ..operators import ranks
from . import views
from .registry import query, r6

D, C, R, E = views.DETECTIONS, views.CLIPS, views.RANGES, views.EVENTS


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with their clip's timeline and an odd moment in seconds."""
    rows = views.detections(spark, sf_dir).filter("slot = 1").join(views.clips(spark, sf_dir).select(F.col("clip").alias("cam"), "fps", "frame_count", "frame_times_s"), "cam")
    return rows.withColumn("s", F.col("mono_ts") + F.col("q") / F.lit(100.0))


MOMENTS = f"(select d.cam, frame_idx, q, mono_ts, fps, frame_count, frame_times_s, mono_ts + q / 100::double as s from {D} d join {C} c on d.cam = c.clip where slot = 1)"
BELOW = "len(list_filter(frame_times_s, lambda t: t < s))"


@query(f"select cam, frame_idx, round(coalesce(frame_times_s[frame_idx + 1], frame_idx / fps), 6) as seconds from {MOMENTS}")
def c5_frame_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = timebase.frame_seconds(F.col("frame_idx"), F.col("fps"), F.col("frame_count"), F.col("frame_times_s"))
    return moments(spark, sf_dir).select("cam", "frame_idx", r6(at).alias("seconds"))


@query(f"""select cam, frame_idx, case when frame_times_s is null then least(999, floor(s * fps)) else least(999, greatest(0, len(list_filter(frame_times_s, lambda t: t <= s)) - 1)) end::bigint as low,
  case when frame_times_s is null then least(999, case when abs(s * fps - floor(s * fps)) < 1e-9 then floor(s * fps) else floor(s * fps) + 1 end) else least(999, {BELOW}) end::bigint as high,
  case when frame_times_s is null then least(999, round_even(s * fps, 0)) else case when {BELOW} <= 0 then 0 when {BELOW} >= 1000 then 999
    when abs(frame_times_s[{BELOW}] - s) <= abs(frame_times_s[{BELOW} + 1] - s) then {BELOW} - 1 else {BELOW} end end::bigint as near from {MOMENTS}""")
def c6_seconds_to_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = [F.col(c) for c in ("s", "fps", "frame_count", "frame_times_s")]
    return moments(spark, sf_dir).select("cam", "frame_idx", *(f(*of).cast("long").alias(n) for n, f in (("low", timebase.frame_floor), ("high", timebase.frame_ceil), ("near", timebase.frame_nearest))))


@query(f"""select clip, len(frame_times_s)::double as n, round(list_sum(list_transform(frame_times_s, lambda t: round(t - frame_times_s[1], 9))), 6) as total, frame_times_s is not null as uneven,
  round(list_sum(list_transform(frame_times_s[11:21], lambda t: round(t - frame_times_s[11], 9))), 6) as part, round(case when frame_times_s is null then frame_count / fps else frame_times_s[-1] + greatest(0, frame_times_s[-1] - frame_times_s[-2]) end, 6) as duration from {C}""")
def c7_frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda a: r6(F.aggregate(a, F.lit(0.0), lambda x, t: x + t))
    t, fps = F.col("frame_times_s"), F.col("fps")
    part = timebase.clip_times(t, F.lit(10), F.lit(20))
    return views.clips(spark, sf_dir).select("clip", F.when(t.isNotNull(), F.size(t)).cast("double").alias("n"), total(timebase.normalised_times(t)).alias("total"), timebase.uneven_times(t, fps).isNotNull().alias("uneven"), total(part).alias("part"), r6(timebase.clip_duration(fps, F.col("frame_count"), t)).alias("duration"))


@query(f"""with s as (select clip, blk, range(start_frame, end_frame + 1, 4) as f from {R} where clip % 3 <> 0),
t as (select *, len(f) as n from s)
select clip, blk, unnest(list_distinct(case when n <= 6 then f else list_transform(range(6), lambda i: f[round_even(i * (n - 1) / 5::double, 0)::int + 1]) end)) as frame_idx from t""")
def c8_stride_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.ranges(spark, sf_dir).join(views.clips(spark, sf_dir).select("clip", "fps", "frame_count", "frame_times_s"), "clip")
    found = timebase.stride_frames(F.col("start_frame"), F.col("end_frame"), F.lit(0.8), F.col("fps"), F.col("frame_count"), F.col("frame_times_s"), 6)
    return rows.select("clip", "blk", F.explode(found).alias("frame_idx"))


@query(f"with f as (select cam, blk, list(frame_idx order by frame_idx) as f from (select cam, frame_idx, cast(floor(frame_idx / 60) as int) as blk from {D} where slot = 1) group by 1, 2) select cam, blk, unnest(case when len(f) <= 7 then f else list_transform(range(7), lambda i: f[floor(i * len(f) / 7::double)::int + 1]) end) as frame_idx from f")
def c9_even_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.detections(spark, sf_dir).filter("slot = 1").withColumn("blk", F.floor(F.col("frame_idx") / views.BLOCK).cast("int"))
    by = rows.groupBy("cam", "blk").agg(F.array_sort(F.collect_list("frame_idx")).alias("f"))
    return by.select("cam", "blk", F.explode(timebase.evenly(F.col("f"), 7)).alias("frame_idx"))


@query(f"select cam, frame_idx from {views.FRAMES} where frame_idx % greatest(1, round_even(5 / 2::double, 0)::int) = 0")
def c10_rate_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = timebase.sample_every(F.lit(views.FPS), F.lit(2.0))
    return views.frames(spark, sf_dir).filter(F.col("frame_idx") % every == 0).select("cam", "frame_idx")


@query(f"select cam, frame_idx, round(100 + frame_idx / 5::double, 6) as mono_ts, 1700000000000000 + round_even(frame_idx / 5::double * 1e6, 0)::bigint as wall_us from {views.FRAMES}")
def c11_frame_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    clocks = timebase.frame_clocks(F.col("frame_idx"), F.lit(views.FPS), F.lit(100.0), F.timestamp_micros(F.lit(1_700_000_000_000_000)))
    return views.frames(spark, sf_dir).select("cam", "frame_idx", clocks.alias("c")).select("cam", "frame_idx", r6("c.mono_ts").alias("mono_ts"), F.unix_micros("c.wall_ts").alias("wall_us"))


@query(f"select event_key, case when event_key % 7 <> 0 and event_key % 2 = 1 then round(start_s - 1700000000, 6) end as source_start_s, case when event_key % 7 <> 0 and event_key % 2 = 1 then round(end_s - 1700000000, 6) end as source_end_s from {E}")
def c12_source_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = lambda c: F.timestamp_micros((F.col(c) * 1e6).cast("long"))
    e = table_times(spark, sf_dir)
    basis = F.when(F.col("event_key") % 7 == 0, "runtime_now").otherwise("filename")
    found = timebase.source_offsets(F.col("start_ts"), F.col("end_ts"), ts_of(1_700_000_000), basis, F.col("event_key") % 2 == 0)
    return e.select("event_key", found.alias("o")).select("event_key", r6("o.source_start_s").alias("source_start_s"), r6("o.source_end_s").alias("source_end_s"))


def ts_of(seconds: int):
    return F.timestamp_micros(F.lit(seconds * 1_000_000))


def table_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with time stamps."""
    stamp = lambda c: F.timestamp_micros(F.bround(F.col(c) * 1e6, 0).cast("long"))
    return views.events(spark, sf_dir).withColumns({"start_ts": stamp("start_s"), "end_ts": stamp("end_s")})


@query(f"""with w as (select camera_id, epoch_us(date_trunc('hour', make_timestamp((min(start_s) * 1e6)::bigint))) as a, epoch_us(date_trunc('hour', make_timestamp((min(start_s) * 1e6)::bigint))) + 7500000000 as b from {E} group by 1)
select camera_id, (k * 3600) as offset_s, ((least(a + k * 3600000000 + 3630000000, b) - a) / 1000000)::bigint as end_s from w, (select unnest(range(3)) as k) where a + k * 3600000000 < b""")
def c13_chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table_times(spark, sf_dir).groupBy("camera_id").agg(F.date_trunc("hour", F.min("start_ts")).alias("a"))
    plan = timebase.chunk_windows(F.col("a"), F.col("a") + F.expr("interval 7500 seconds"), 3600, 30)
    rows = by.select("camera_id", "a", F.explode(plan).alias("w"))
    return rows.select("camera_id", (F.unix_seconds("w.start") - F.unix_seconds("a")).alias("offset_s"), (F.unix_seconds("w.end") - F.unix_seconds("a")).alias("end_s"))


@query(f"""select event_key, start_s < end_s and start_s + event_key % 5 < start_s + 3 as overlap, round(case when least(start_s + 3, end_s) > greatest(start_s, start_s + event_key % 5) then
  (least(start_s + 3, end_s) - (start_s + event_key % 5)) / (greatest(start_s + 3, end_s) - start_s) else 0 end, 5) as iou from {E} where end_s is not null""")
def c14_time_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = F.col("start_s"), F.col("end_s")
    late = s + F.col("event_key") % 5
    rows = views.events(spark, sf_dir).filter("end_s is not null")
    return rows.select("event_key", timebase.overlap(s, s + 3, late, e).alias("overlap"), F.round(timebase.time_iou(s, s + 3, late, e), 5).alias("iou"))


@query(f"select clip, split_part(source_id, '@', 1) as camera_id, 'cam' || clip::varchar as camera_name, day from {C}")
def c15_clip_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.metadata import clip_identity

    names = views.clips(spark, sf_dir).select(F.split("source_id", "@")[0].alias("camera_id"), F.concat(F.lit("cam"), F.col("clip").cast("string")).alias("camera_name"))
    rows = views.clips(spark, sf_dir).withColumns({"camera_name": F.lit(None).cast("string"), "source_start_s": F.lit(0.0), "span_start_s": F.lit(None).cast("double"), "start_s": F.lit(1.5)})
    return clip_identity(rows, names).select("clip", "camera_id", "camera_name", "day")


@query(f"select event_key, round(modified_s - recorded_s, 6) as latency_s from {E}")
def c16_trigger_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = lambda c: F.timestamp_micros(F.bround(F.col(c) * 1e6, 0).cast("long"))
    return views.events(spark, sf_dir).select("event_key", r6(timebase.seconds_between(stamp("recorded_s"), stamp("modified_s"))).alias("latency_s"))


TEXTS = f"""(select event_key, strftime(make_timestamp((start_s * 1e6)::bigint), '%Y-%m-%dT%H:%M:%S') as iso, event_key % 4 as kind from {E})"""


@query(f"select event_key, case when kind = 3 then null else epoch(strptime(iso, '%Y-%m-%dT%H:%M:%S'))::double - case when kind = 2 then 36000 else 0 end end as utc_s from {TEXTS}")
def c1_metadata_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso, k = F.date_format("start_ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("event_key") % 4
    text = F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, iso).when(k == 2, F.concat(iso, F.lit("+10:00"))).otherwise("not a time")
    return table_times(spark, sf_dir).select("event_key", F.unix_seconds(timebase.parsed_utc(text)).cast("double").alias("utc_s"))


@query(f"select event_key, case when kind = 3 then null else epoch(strptime(iso, '%Y-%m-%dT%H:%M:%S'))::double - case kind when 0 then 36000 when 1 then -(5 * 3600 + 30 * 60) else 0 end end as utc_s from {TEXTS}")
def c2_export_name_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, k = F.date_format("start_ts", "M-d-yyyy, H.mm.ss"), F.col("event_key") % 4
    zone = F.when(k == 0, "GMT+10").when(k == 1, "GMT-5:30").otherwise("GMT+0")
    name = F.when(k == 3, "Yard 13-40-2024, 1.00.00 GMT+1.mp4").otherwise(F.concat(F.lit("Yard "), at, F.lit(" "), zone, F.lit(" - x.mp4")))
    return table_times(spark, sf_dir).select("event_key", F.unix_seconds(timebase.export_name_time(name)).cast("double").alias("utc_s"))


@query(f"select event_key, case when kind = 3 then null else epoch(strptime(iso, '%Y-%m-%dT%H:%M:%S'))::double - case when kind = 2 then 36000 else 0 end end as utc_s from {TEXTS}")
def c3_iso_name_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, k = F.date_format("start_ts", "yyyyMMdd'T'HHmmss"), F.col("event_key") % 4
    name = F.when(k == 3, "cam_20241399T250000Z.mp4").otherwise(F.concat(F.lit("cam_"), at, F.when(k == 0, "Z").when(k == 1, "").otherwise("+1000"), F.lit(".mp4")))
    return table_times(spark, sf_dir).select("event_key", F.unix_seconds(timebase.iso_name_time(name)).cast("double").alias("utc_s"))


@query(f"select event_key, case kind when 0 then 'config' when 1 then 'filename' else 'mtime' end as basis, epoch(strptime(iso, '%Y-%m-%dT%H:%M:%S'))::double + case kind when 0 then 5 when 1 then 0 else 9 end as utc_s from {TEXTS}")
def c4_time_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_key") % 4
    second = F.date_trunc("second", "start_ts")
    name = F.when(k <= 1, F.concat(F.lit("cam_"), F.date_format("start_ts", "yyyyMMdd'T'HHmmss"), F.lit("Z.mp4"))).otherwise("plain.mp4")
    anchor = timebase.time_anchor(name, second + F.expr("interval 9 seconds"), F.when(k == 0, second + F.expr("interval 5 seconds")))
    return table_times(spark, sf_dir).select("event_key", anchor.alias("a")).select("event_key", "a.basis", F.unix_seconds("a.ts").cast("double").alias("utc_s"))


# --- keys

URL = "case event_key % 4 when 0 then 'rtsp://user:pw@cam' || camera_id || '/live?token=abc&x=' || event_key::varchar || '#f' when 1 then 'http://h/p?API_KEY=1&b=2' when 2 then '/data/' || event_key::varchar || '.mp4' else 'rtsp://cam/s' end"
SAFE = "case event_key % 4 when 0 then 'rtsp://cam' || camera_id || '/live?x=' || event_key::varchar when 1 then 'http://h/p?b=2' when 2 then '/data/' || event_key::varchar || '.mp4' else 'rtsp://cam/s' end"


def urls():
    k, cam = F.col("event_key").cast("string"), F.col("camera_id")
    n = F.col("event_key") % 4
    return F.when(n == 0, F.concat(F.lit("rtsp://user:pw@cam"), cam, F.lit("/live?token=abc&x="), k, F.lit("#f"))).when(n == 1, "http://h/p?API_KEY=1&b=2").when(n == 2, F.concat(F.lit("/data/"), k, F.lit(".mp4"))).otherwise("rtsp://cam/s")


@query(f"select event_key, {SAFE} as source_id from {E}")
def d1_secret_free_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.events(spark, sf_dir).select("event_key", keys.secret_free(urls()).alias("source_id"))


PART = "coalesce(nullif(trim(regexp_replace(regexp_replace({}, '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '._'), ''), 'unknown')"


@query(f"select event_key, {PART.format(SAFE)} as part, strftime(make_timestamp((start_s * 1e6)::bigint), '%Y%m%dT%H%M%SZ') as stamp from {E}")
def d2_path_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_times(spark, sf_dir).select("event_key", keys.path_part(urls()).alias("part"), keys.utc_stamp(F.col("start_ts")).alias("stamp"))


@query(f"""select event_key, 'cam_' || camera_id || '/' || strftime(t, '%Y-%m-%d') || '/events/' || strftime(t, '%Y%m%dT%H%M%SZ') || '_cam_' || camera_id || '_1_' || event_id as path from (select *, make_timestamp((start_s * 1e6)::bigint) as t from {E})""")
def a12_event_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = keys.event_path(F.col("camera_id"), F.concat(F.lit("cam "), F.col("camera_id")), F.col("start_ts"), F.lit("1"), F.col("event_id"))
    return table_times(spark, sf_dir).select("event_key", path.alias("path"))


@query(f"select clip, blk, lpad(start_frame::varchar, 7, '0') || '_' || lpad(end_frame::varchar, 7, '0') || '_t' || coalesce(track_id, '9') || '_' || sha1('src' || clip::varchar || '|' || start_frame::varchar || '|' || end_frame::varchar || '|' || coalesce(track_id, '9'))[1:10] as span_id from {R}")
def d3_span_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat(F.lit("src"), F.col("clip").cast("string"))
    return views.ranges(spark, sf_dir).select("clip", "blk", keys.span_id(source, F.col("start_frame"), F.col("end_frame"), F.coalesce("track_id", F.lit("9"))).alias("span_id"))


@query(f"select clip, case when ('0x' || sha1('cam' || clip::varchar || '_x|' || day)[1:8])::bigint / 4294967295::double < 0.3::double then 'val' else 'train' end as split from {C}")
def d4_leak_free_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.clips(spark, sf_dir).select("clip", keys.split_of(keys.split_key(F.col("source_id"), F.col("day")), 0.3).alias("split"))


@query(f"select camera_id, 'sheep,' || min(event_type) as aliases, 'Rex,Bo' as roster from {E} group by camera_id")
def d5_class_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = views.events(spark, sf_dir).groupBy("camera_id").agg(F.min("event_type").alias("t"))
    names = F.array(F.lit(" Sheep "), F.lit("dog"), F.lit(""), F.upper("t"), F.lit("sheep"), F.lit("DOG "))
    return by.select("camera_id", F.array_join(keys.alias_classes(names), ",").alias("aliases"), F.array_join(keys.roster(F.array(F.lit("Rex "), F.lit(""), F.lit("Bo"), F.lit("Rex"))), ",").alias("roster"))


@query(f"select event_key, coalesce(name, case when event_key % 3 = 0 then 'walle' else 'unknown' end) as name, label in ('pee', 'poop') as trainable from {E}")
def d6_vocabularies(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("name").isNotNull(), F.concat(F.lit(" G-ROMIT"))).when(F.col("event_key") % 3 == 0, "wall_E").otherwise("somebody")
    return views.events(spark, sf_dir).select("event_key", keys.identity(given, F.array(*map(F.lit, keys.IDENTITIES))).alias("name"), keys.is_trainable(F.col("label")).alias("trainable"))


@query(f"select reason, count(*) as n from (select case when start_frame - 3 < 0 then 'negative start' when end_frame - blk * 9 < start_frame - 3 then 'end before start' when end_s < start_s + 2.5::double - 1e-6 then 'end time before start time' else 'fine' end as reason from {R}) group by 1")
def d7_range_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import labels

    rows = views.ranges(spark, sf_dir).withColumns({"start_frame": F.col("start_frame") - 3, "end_frame": F.col("end_frame") - F.col("blk") * 9, "start_s": F.col("start_s") + 2.5})
    good, bad = labels.validated(rows)
    return good.withColumn("reason", F.lit("fine")).select("reason").unionByName(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"select event_key, try_cast(case event_key % 4 when 0 then 'true' when 1 then value::varchar when 2 then 'x' end as double) as number, case when label in ('pee', 'poop') then label else 'unknown' end as label from {E} where event_key % 4 <> 1")
def d9_lenient_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_key") % 4
    text = F.when(n == 0, "true").when(n == 1, F.col("value").cast("string")).when(n == 2, "x")
    return views.events(spark, sf_dir).select("event_key", keys.lenient_double(text).alias("number"), keys.lenient_choice(F.upper("label"), keys.LABELS, "unknown").alias("label"))


@query(f"select event_key, row_number() over (order by coalesce(try_cast(t as int), 0), t, event_key) as place from (select event_key, case when event_key % 9 = 0 then 'a' || (event_key % 50)::varchar else (event_key % 300)::varchar end as t from {E} where event_key % 10 = 0)")
def i4_numeric_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = F.when(F.col("event_key") % 9 == 0, F.concat(F.lit("a"), (F.col("event_key") % 50).cast("string"))).otherwise((F.col("event_key") % 300).cast("string"))
    rows = views.events(spark, sf_dir).select("event_key", track.alias("t"))
    return ranks.placed(rows, *keys.numeric_first(F.col("t")), "event_key").select("event_key", "place")
