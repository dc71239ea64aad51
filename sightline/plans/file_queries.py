"""Queries over trees of metadata files, which Spark writes from the tables first, and over streams of their events."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import shared_folder
from ..operators import dwell
from ..sources import metadata, tree
from ..streaming import dwelling, release, sightings
from . import views
from .event_queries import chosen
from .registry import SQL, query
from .track_queries import folder, sources

R, C, E = views.RANGES, views.CLIPS, views.EVENTS


def iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def event_files(spark: SparkSession, sf_dir: str) -> str:
    """An event for each block of a camera: every fifth without an id, every seventh broken, every eleventh no object."""
    rows = views.ranges(spark, sf_dir)
    clip = F.col("clip").cast("long")  # seconds of all clips pass an int
    number = clip * 100 + F.col("blk")
    start = F.lit(1_700_000_000) + clip * 86_400 + F.col("start_s")
    about = F.to_json(F.struct(
        F.when(number % 5 != 0, F.concat(F.lit("id"), number.cast("string"))).alias("event_id"), F.concat(F.lit("cam"), F.col("clip").cast("string")).alias("camera_id"), F.lit("src").alias("sanitized_source_id"),
        iso(start).alias("utc_ts"), F.when(F.col("blk") % 2 == 0, F.lit("unknown")).otherwise(F.lit("pee")).alias("label"), F.lit("not a number").alias("source_start_s"),
    ))
    text = F.when(number % 7 == 0, "{broken").when(number % 11 == 0, "[]").otherwise(about)
    path = F.concat(F.lit("Cam"), F.col("clip").cast("string"), F.lit("/"), F.date_format(F.timestamp_seconds(start), "yyyy-MM-dd"), F.lit("/events/e"), F.lpad(number.cast("string"), 8, "0"), F.lit("/metadata.json"))
    root = folder(spark, "tree")
    metadata.write_files(rows.select(path.alias("path"), text.alias("text")), root)
    return root


@query(f"""select 'Cam' || clip::varchar as camera_dir, strftime(t, '%Y-%m-%d') as date_dir, 'e' || lpad(n::varchar, 8, '0') as dir_name,
  case when n % 5 <> 0 then 'id' || n::varchar else 'e' || lpad(n::varchar, 8, '0') end as event_id, 'cam' || clip::varchar as camera_id,
  case when blk % 2 = 0 then 'unknown' else 'pee' end as label, epoch_us(t) / 1000000 as start_s
  from (select clip, blk, clip * 100 + blk as n, make_timestamp((floor(1700000000 + clip * 86400 + start_s)::bigint * 1000000)) as t from {R}) where n % 7 <> 0 and n % 11 <> 0""")
def a1_event_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metadata.event_times(metadata.read_events(spark, event_files(spark, sf_dir)))
    return rows.select("camera_dir", "date_dir", "dir_name", "event_id", "camera_id", "label", F.col("start_s").cast("double").alias("start_s"))


@query(SQL["a1_event_scan"])
def a1_event_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scan by camera and date."""
    rows = tree.read_event_tree(spark, event_files(spark, sf_dir))
    start = F.unix_micros(F.to_timestamp("utc_ts")) / 1e6
    return rows.select("camera_dir", "date_dir", "dir_name", "event_id", "camera_id", "label", start.alias("start_s"))


@query(f"select dir_name, event_id from ({SQL['a1_event_scan']}) where camera_dir in ('Cam1', 'Cam3') and date_dir >= '2023-11-16'")
def a1_some_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cameras, from a day on: no other file is opened."""
    rows = tree.read_event_tree(spark, event_files(spark, sf_dir)).filter("camera_dir in ('Cam1', 'Cam3') and date_dir >= '2023-11-16'")
    return rows.select("dir_name", "event_id")


def clip_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder for each clip: its metadata, its labels, and but for every fourth a video (a few bytes that stand for one),
    whose name is in capitals for every third."""
    clips, ranges = views.clips(spark, sf_dir), views.ranges(spark, sf_dir)
    at = F.concat(F.lit("clips/c"), F.col("clip").cast("string"))
    about = F.to_json(F.struct(at.alias("span_id"), "source_id", "fps", "frame_count", "width", "height", F.lit(1).alias("unknown_field")))
    one = F.struct("start_frame", "end_frame", "start_s", "end_s", "behavior", F.col("name").alias("dog"), "track_id")
    labels = ranges.groupBy("clip").agg(F.to_json(F.struct(F.array_sort(F.collect_list(one)).alias("ranges"))).alias("text"))
    video = clips.filter("clip % 4 <> 0").select(F.concat(at, F.lit("/clip.mp4")).alias("path"), F.concat(F.lit("video "), F.col("source_id")).alias("text"))
    more = clips.filter("clip % 3 = 0").select(F.concat(at, F.lit("/TAKE.MOV")).alias("path"), F.concat(F.lit("take "), F.col("source_id")).alias("text"))
    files = clips.select(F.concat(at, F.lit("/metadata.json")).alias("path"), about.alias("text")).unionByName(labels.select(F.concat(at, F.lit("/labels.json")).alias("path"), "text")).unionByName(video).unionByName(more)
    root = folder(spark, "clips")
    metadata.write_files(files, root)
    return root


def name_of(path: str, back: int = 1) -> Column:
    return F.element_at(F.split(path, "/"), -back)


@query(f"select 'clips/c' || clip::varchar as span_id, source_id, fps, frame_count, width, height from {C} where clip % 4 <> 0")
def a3_clip_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.read_clips(spark, clip_files(spark, sf_dir)).select("span_id", "source_id", "fps", "frame_count", "width", "height")


@query(f"select distinct 'c' || clip::varchar as clip, start_frame, end_frame, start_s, end_s, behavior, name as dog, track_id from {R} where clip % 4 <> 0")
def a4_label_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.read_label_ranges(spark, clip_files(spark, sf_dir)).select("clip", "start_frame", "end_frame", "start_s", "end_s", "behavior", "dog", "track_id")


@query(SQL["a3_clip_scan"])
def a3_clip_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tree.read_clip_tree(spark, clip_files(spark, sf_dir), metadata.CLIPS, "metadata.json")
    return rows.select("span_id", "source_id", "fps", "frame_count", "width", "height")


@query(SQL["a4_label_scan"])
def a4_label_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tree.read_clip_tree(spark, clip_files(spark, sf_dir), metadata.LABELS, "labels.json")
    rows = rows.select(F.coalesce("clip", "clip_name").alias("clip"), F.inline("ranges")).distinct()
    return rows.select("clip", "start_frame", "end_frame", "start_s", "end_s", "behavior", "dog", "track_id")


@query(f"select 'c' || clip::varchar as clip, 'clip.mp4' as file, length('video ' || source_id)::bigint as length from {C} where clip % 4 <> 0 union all select 'c' || clip::varchar, 'TAKE.MOV', length('take ' || source_id)::bigint from {C} where clip % 3 = 0")
def a7_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.recordings(spark, clip_files(spark, sf_dir)).select(name_of("path", 2).alias("clip"), name_of("path").alias("file"), "length")


@query(f"select 'c' || clip::varchar as clip, sha256('video ' || source_id) as checksum from {C} where clip % 4 <> 0")
def a16_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.checksums(spark, clip_files(spark, sf_dir), "clip.mp4").select(name_of("path", 2).alias("clip"), "checksum")


@query()
def a15_manifest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest as written, read back."""
    from ..operators import labels

    path = folder(spark, "manifest")
    metadata.write_manifest(labels.manifest(chosen(spark, sf_dir), views.clips(spark, sf_dir)), path)
    return spark.read.option("header", True).csv(path)


# --- suppression and streams


@query()
def k3_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks that an event rules out, from its end until the cooldown is over or no track is alive."""
    settings = dwell.Settings(1.0, 2.0, 1.0)
    found = dwell.dwell_events(*sources(spark, sf_dir), settings, 5.0, 5).filter("not near_miss")
    return found.select("source", F.explode("track_ids").alias("track_id"), F.col("end_mono").alias("since_s"), (F.col("end_mono") + settings.cooldown_s).alias("until_s"))


@query()
def k3_suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppression as the machine applies it: over when the cooldown is, or earlier when no track is alive."""
    return dwell.suppressions(*sources(spark, sf_dir), dwell.Settings(1.0, 2.0, 1.0), 5.0, 5).drop("segment")


def drained(frame: DataFrame, spark: SparkSession) -> DataFrame:
    """All that a stream gives of what is there now, as a table."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    frame.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{at}/out")


@query(f"""with d as (select event_key, floor(coalesce(end_s, start_s) * 1000000)::bigint + 30000000 as due from {E})
select event_key from d where (due // 1000000 + 1) * 1000 <= (select max(due) // 1000 from d)""")
def k5_released(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.events(spark, sf_dir).select("event_key", F.timestamp_micros(F.floor(F.coalesce("end_s", "start_s") * 1e6).cast("long")).alias("end_ts"))
    path = folder(spark, "pending")
    rows.write.parquet(path)
    return drained(sightings.released(spark.readStream.schema(rows.schema).parquet(path), 30.0), spark).select("event_key")


@query(f"select distinct event_id from {E} where event_key % 4 <> 0")
def k6_new_event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is fed in, every third one twice; a quarter was known at the start."""
    rows = views.events(spark, sf_dir)
    at = F.timestamp_seconds("start_s").alias("recorded_at")
    path = folder(spark, "feed")
    rows.select("event_id", at).unionByName(rows.filter("event_key % 3 = 0").select("event_id", at)).write.json(path)
    feed = sightings.new_events(spark, path, "event_id string, recorded_at timestamp", rows.filter("event_key % 4 = 0").select("event_id"))
    return drained(feed, spark).select("event_id")


@query(f"""with d as (select event_key, floor(coalesce(end_s, start_s) * 1000)::bigint as end_ms from {E})
select event_key, case when end_ms + 30000 <= (select max(end_ms) from d) - 10000 then 'due' else 'shutdown' end as reason from d""")
def k5_shutdown_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event leaves: when its post-roll is over, 10 seconds of disorder allowed for, or else when the run stops.
    The run is stopped and started again halfway."""
    rows = views.events(spark, sf_dir).select("event_key", F.timestamp_millis(F.floor(F.coalesce("end_s", "start_s") * 1000).cast("long")).alias("end_ts"))
    path, out, state = folder(spark, "pending"), folder(spark, "released"), folder(spark, "state")
    first, last = rows.agg(F.unix_millis(F.min("end_ts")), F.unix_millis(F.max("end_ts"))).first()
    half = F.timestamp_millis(F.lit((first or 0) + ((last or 0) - (first or 0)) // 2))
    rows.filter(F.col("end_ts") < half).write.mode("append").parquet(path)
    stream = release.released(spark.readStream.schema(rows.schema).parquet(path), 30.0, delay="10 seconds")
    release.run_to_end(stream, out, state)
    rows.filter(F.col("end_ts") >= half).write.mode("append").parquet(path)
    return release.drained(stream, out, state).select("event_key", "reason")


@query(f"select distinct event_id, floor(start_s)::bigint as recorded_s from {E} where event_key % 4 <> 0")
def k6_feed_for_ever(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once for ever: all are fed in, every third one twice, and after a restart again, a day later. A quarter
    was known at the first start."""
    rows = views.events(spark, sf_dir).select("event_key", "event_id", F.floor("start_s").cast("long").alias("recorded_s"))
    path, out, state = folder(spark, "feed"), folder(spark, "fed"), folder(spark, "state")
    rows.unionByName(rows.filter("event_key % 3 = 0")).write.mode("append").parquet(path)
    known = rows.filter("event_key % 4 = 0").select("event_id")
    feed = release.new_once(spark.readStream.schema(rows.schema).parquet(path), known, kept=folder(spark, "known"))
    release.run_to_end(feed, out, state)
    rows.withColumn("recorded_s", F.col("recorded_s") + 86_400).write.mode("append").parquet(path)
    release.run_to_end(feed, out, state)
    return spark.read.schema(feed.schema).parquet(out).select("event_id", "recorded_s")


@query()
def k2_dwell_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k2_dwell_events as a stream, stopped and started twice; a last row tells that time has gone on."""
    frames, found = sources(spark, sf_dir)
    box = F.struct(F.col("det_rank"), *(F.col(c) for c in ("x1", "y1", "x2", "y2", "confidence")))
    boxes = found.groupBy("source", "frame_idx").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    rows = frames.join(boxes, ["source", "frame_idx"], "left").withColumn("wall_ts", F.timestamp_seconds(F.col("mono_ts") + 1_700_000_000))
    path, out, state = folder(spark, "sightings"), folder(spark, "dwelt"), folder(spark, "state")
    closing = rows.groupBy().agg(F.max("wall_ts").alias("t")).select(F.lit("").alias("source"), F.timestamp_seconds(F.unix_seconds("t") + 3600).alias("wall_ts"))
    for low, high in ((0, 70), (70, 140), (140, None)):
        rows.filter((F.col("mono_ts") >= low) & (F.lit(True) if high is None else F.col("mono_ts") < high)).write.mode("append").parquet(path)
        if high is None:
            closing.select(*(F.col(f.name) if f.name in closing.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema)).write.mode("append").parquet(path)
        stream = dwelling.dwell_stream(spark.readStream.schema(rows.schema).parquet(path), dwell.Settings(1.0, 2.0, 1.0), 5.0, 5)
        release.run_to_end(stream, out, state)
    return spark.read.schema(stream.schema).parquet(out).withColumn("track_ids", F.array_join("track_ids", ","))
