"""Metadata files of events, clips, labels, packets and recordings, read with fixed schemas and leniently: a field of the
wrong kind is null, a file that is no object is left out."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import timebase

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
DETECTION = f"struct<frame_idx:int,mono_ts:double,wall_ts:string,bbox:{BOX},confidence:double,class_name:string,track_id:string>"
EVENTS = (
    "schema_version string, event_id string, camera_id string, camera_name string, sanitized_source_id string, utc_ts string, end_ts string, recorded_at string, source_start_s double, source_end_s double, time_basis string, "
    "protect_event_id string, detection_ts string, notification_ts string, model_name string, trigger_reason string, pre_roll_s double, post_roll_s double, multi_dog boolean, ambiguous boolean, classifier_guess string, classifier_confidence double, "
    f"label_status string, label string, dog string, frame_records array<struct<frame_idx:int,source_id:string,original_width:int,original_height:int>>, detections array<{DETECTION}>, "
    f"tracks array<struct<track_id:string,detections:array<{DETECTION}>>>, crop_boxes array<struct<frame_idx:int,bbox:{BOX},margin_frac:double,path:string>>, extra struct<label_note:string,labeled_at:string,primary_track_id:string,lifecycle:string,near_miss:boolean,stationary_duration_s:double>"
)
CLIPS = (
    "schema_version string, span_id string, source_id string, source_path string, camera_name string, detect_conf double, model_name string, source_start_utc string, source_span_start_utc string, source_span_end_utc string, "
    "fps double, frame_count int, width int, height int, timebase string, sample_every int, track_id string, source_start_frame int, source_end_frame int, start_s double, end_s double, frame_times_s array<double>, "
    f"detections array<struct<clip_frame_idx:int,source_frame_idx:int,time_s:double,track_id:string,bbox:{BOX},confidence:double,class_name:string>>, checksum string"
)
LABELS = "schema_version string, clip string, ranges array<struct<start_frame:int,end_frame:int,start_s:double,end_s:double,behavior:string,dog:string,track_id:string,time_basis:string,created_at:string>>"
PACKETS = "packets array<struct<pts_time:string,dts_time:string,size:string,flags:string>>"
VIDEO_SUFFIXES = (".mp4", ".mov", ".mkv", ".avi", ".m4v")  # fixed values


def read_json(spark: SparkSession, path: str, schema: str, name: str | None = None) -> DataFrame:
    """One row for each file that holds an object, with file_path and bad (what could not be read, else null). name: of
    the files, at any depth below path; no other is opened."""
    fields = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else spark.createDataFrame([], schema).schema
    full = T.StructType([*fields.fields, T.StructField("bad", T.StringType())])
    reader = spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad")
    if name:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", name)
    rows = reader.json(path).withColumn("file_path", F.col("_metadata.file_path"))
    # a field of the wrong kind also marks a row as bad; only what is no object, and so has no field at all, is
    none = F.from_json("bad", "map<string,string>").isNull() & F.coalesce(*(F.col(f.name).cast("string") for f in fields.fields if isinstance(f.dataType, T.AtomicType))).isNull()
    return rows.withColumn("bad", F.when(none, F.col("bad")))


def read_events(spark: SparkSession, root: str) -> DataFrame:
    """<root>/<camera>/<date>/events/<event>/metadata.json at this depth only; the directory names fill in."""
    rows = read_json(spark, f"{root}/*/*/events/*/metadata.json", EVENTS).filter("bad is null")
    plain = F.url_decode(F.replace(F.col("file_path"), F.lit("+"), F.lit("%2B")))  # a path comes as a URL
    part = lambda i: F.element_at(F.split(plain, "/"), -i)
    rows = rows.withColumns({"dir_name": part(2), "date_dir": part(4), "camera_dir": part(5)})
    return rows.withColumn("event_id", F.coalesce(F.nullif("event_id", F.lit("")), "dir_name")).drop("bad")


def bad_events(spark: SparkSession, root: str) -> DataFrame:
    return read_json(spark, f"{root}/*/*/events/*/metadata.json", EVENTS).select("file_path", "bad", "event_id").filter("bad is not null")


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime and length of files below root; contents are not read. Spark's
    listing leaves out files without a byte."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "modificationTime", "length")


def read_clips(spark: SparkSession, root: str) -> DataFrame:
    """Clips that have both metadata and a video."""
    folder = lambda c: F.regexp_replace(c, "/[^/]+$", "")
    rows = read_json(spark, root, CLIPS, "metadata.json").filter("bad is null").withColumn("clip_dir", folder(F.col("file_path")))
    return rows.join(files(spark, root, "clip.mp4").select(folder(F.col("path")).alias("clip_dir")), "clip_dir", "left_semi").drop("bad")


def read_label_ranges(spark: SparkSession, root: str) -> DataFrame:
    """One row for each range of labels.json files whose clip has a video."""
    folder = lambda c: F.regexp_replace(c, "/[^/]+$", "")
    rows = read_json(spark, root, LABELS, "labels.json").filter("bad is null").withColumn("clip_dir", folder(F.col("file_path")))
    rows = rows.join(files(spark, root, "clip.mp4").select(folder(F.col("path")).alias("clip_dir")), "clip_dir", "left_semi")
    return rows.select("clip_dir", F.coalesce("clip", F.element_at(F.split("clip_dir", "/"), -1)).alias("clip"), F.inline("ranges")).distinct()


def recordings(spark: SparkSession, root: str) -> DataFrame:
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files(spark, root).filter(suffix.isin(*VIDEO_SUFFIXES)).orderBy("path")


def opened(path: str):
    """A file system and a path in it, of a path as Spark names it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub("^(file:)?/+", "file:///", path) if path.startswith(("/", "file:")) else path)


def checksums(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path and checksum (null if it can't be read) of files, read in blocks of a megabyte, never whole."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                try:
                    system, place = opened(path)
                    with system.open_input_stream(place) as stream:
                        while block := stream.read(1 << 20):
                            digest.update(block)
                    found.append(digest.hexdigest())
                except OSError:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["path", "checksum"])

    return files(spark, root, pattern).select("path").mapInArrow(run, "path string, checksum string")


def write_files(rows: DataFrame, root: str) -> int:
    """One file for each row (path below root, text), in folders as needed; how many were written. A row that is written
    again replaces its former self, so tasks may be tried again."""

    def run(batches):
        import pyarrow as pa

        system, top = opened(root)
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system.create_dir(f"{top}/{path.rpartition('/')[0]}", recursive=True)
                with system.open_output_stream(f"{top}/{path}") as stream:
                    stream.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.select("path", "text").mapInArrow(run, "n long").agg({"n": "sum"}).first()[0] or 0


def camera_names(texts: DataFrame, column: str = "value") -> DataFrame:
    """camera_id, camera_name of JSON objects as text, later rows (by seq) winning; what is no object is empty."""
    names = F.from_json(column, "map<string,string>")
    rows = texts.select("seq", F.explode(names).alias("camera_id", "camera_name"))
    return rows.groupBy("camera_id").agg(F.max_by("camera_name", "seq").alias("camera_name"))


def parsed_packets(texts: DataFrame, column: str = "value") -> DataFrame:
    """Packets of JSON texts with string numbers: pts_time (else dts_time; null if no number), size (0 if no number),
    is_keyframe."""
    rows = texts.select(*(c for c in texts.columns if c != column), F.inline(F.from_json(column, PACKETS)["packets"]))
    kept = [c for c in texts.columns if c != column]
    return rows.select(*kept, F.coalesce("pts_time", "dts_time").try_cast("double").alias("pts_time"), F.coalesce(F.col("size").try_cast("long"), F.lit(0)).alias("size"), F.coalesce(F.col("flags").contains("K"), F.lit(False)).alias("is_keyframe"))


def clip_identity(clips: DataFrame, names: DataFrame) -> DataFrame:
    """clips with camera_id (before the @ of the source), camera_name (its own, else the side table's, else the id),
    and both starts: the span's and the source's derive from each other through start_s."""
    rows = clips.withColumn("camera_id", F.when(F.col("source_id").contains("@"), F.split("source_id", "@")[0]))
    side = names.select(F.col("camera_id").alias("i_"), F.col("camera_name").alias("n_"))
    rows = rows.join(side, rows["camera_id"] == side["i_"], "left").withColumn("camera_name", F.coalesce(F.nullif("camera_name", F.lit("")), "n_", "camera_id")).drop("i_", "n_")
    return rows.withColumns({"span_start_s": F.coalesce("span_start_s", F.col("source_start_s") + F.col("start_s")), "source_start_s": F.coalesce("source_start_s", F.col("span_start_s") - F.col("start_s"))})


def event_times(events: DataFrame) -> DataFrame:
    """Events as the operators want them: keys, doubles for times, label fields at the top."""
    seconds = lambda c: F.unix_micros(timebase.parsed_utc(F.col(c))) / 1e6
    return events.select(
        F.concat_ws("/", "camera_dir", "date_dir", "dir_name").alias("event_key"), "camera_id", F.col("sanitized_source_id").alias("source_id"), seconds("utc_ts").alias("start_s"), seconds("end_ts").alias("end_s"), "source_start_s", "source_end_s",
        F.col("protect_event_id").alias("provider_id"), "dir_name", "event_id", "label", "label_status", F.col("dog").alias("name"), F.col("extra.label_note").alias("label_note"), F.col("extra.labeled_at").alias("labeled_at"),
        seconds("recorded_at").alias("recorded_s"), F.lit(None).cast("double").alias("modified_s"), "camera_dir", "date_dir", "camera_name", "utc_ts",
    )


def write_events(events: DataFrame, path: str) -> None:
    """The event table by camera and date; days that are written replace their former selves, others stay."""
    events.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("camera_dir", "date_dir").parquet(path)


def write_labels(ranges: DataFrame, path: str) -> None:
    """The label table, clips side by side in files of ranges of clips: a filter on a clip reads the row groups that may
    hold it, and no clip has a folder of its own."""
    ranges.repartitionByRange("clip").sortWithinPartitions("clip", "start_frame").write.mode("overwrite").parquet(path)


#: The columns of a manifest file.
MANIFEST = ("crop_path", "dog_crop_path", "behavior", "dog", "track_id", "clip_id", "source_id", "date", "split", "matched")


def manifest_columns(rows: DataFrame) -> DataFrame:
    """What labels.manifest returns under the manifest file's names."""
    of = {"crop_path": "behavior_path", "dog_crop_path": "name_path", "dog": "name", "clip_id": "clip", "date": "day"}
    return rows.select(*(F.col(of.get(c, c)).cast("string").alias(c) for c in MANIFEST))


def write_manifest(rows: DataFrame, path: str) -> None:
    """CSV files with a header, of what labels.manifest returns."""
    manifest_columns(rows).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
