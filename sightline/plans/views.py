"""Camera-sighting views over generic tables: each as a DataFrame, and as SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import Box

FPS, BLOCK, PER_CAMERA = 5.0, 60, 1000
WIDTH, HEIGHT = 1280, 720


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cam, frame_idx, slot, mono_ts, x1..y2, confidence, det_rank, class_name: two subjects on each camera, which stand
    still for a block of frames and then jump."""
    q = F.max(F.col("l_quantity").cast("int")).alias("q")
    slot = F.when(F.col("l_linenumber") <= 3, 1).otherwise(2)
    rows = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 5").groupBy("l_orderkey", slot.alias("slot")).agg(q)
    q, slot = F.col("q"), F.col("slot")
    frame = (F.col("l_orderkey") % PER_CAMERA).cast("int")
    blk = F.floor(frame / BLOCK).cast("int")
    x, y = 100 + 640 * (slot - 1) + blk * 37 % 200 + q % 3, 200 + blk * 53 % 150 + q % 2
    return rows.select(
        F.floor(F.col("l_orderkey") / PER_CAMERA).cast("int").alias("cam"), frame.alias("frame_idx"), "slot", (frame / FPS).alias("mono_ts"), x.cast("double").alias("x1"), y.cast("double").alias("y1"),
        (x + 80 + q % 5).cast("double").alias("x2"), (y + 60 + q % 4).cast("double").alias("y2"), (F.lit(20.0) / 100 + q * F.lit(15.0) / 1000).alias("confidence"), "q",
        (slot - 1).alias("det_rank"), F.when(q % 7 == 0, "sheep").otherwise("dog").alias("class_name"),
    )


DETECTIONS = """(with b as (select l_orderkey, case when l_linenumber <= 3 then 1 else 2 end as slot, max(cast(l_quantity as int)) as q
  from lineitem where l_linenumber <= 5 group by 1, 2),
c as (select slot, q, cast(floor(l_orderkey / 1000) as int) as cam, cast(l_orderkey % 1000 as int) as frame_idx, cast(floor((l_orderkey % 1000) / 60) as int) as blk from b)
select cam, frame_idx, slot, q, frame_idx / cast(5 as double) as mono_ts, slot - 1 as det_rank, case when q % 7 = 0 then 'sheep' else 'dog' end as class_name,
  cast(100 + 640*(slot-1) + (blk*37)%200 + q%3 as double) as x1, cast(200 + (blk*53)%150 + q%2 as double) as y1,
  cast(180 + 640*(slot-1) + (blk*37)%200 + q%3 + q%5 as double) as x2, cast(260 + (blk*53)%150 + q%2 + q%4 as double) as y2,
  cast(20 as double)/100 + q*cast(15 as double)/1000 as confidence from c)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame of every camera, empty ones too."""
    cams = detections(spark, sf_dir).select("cam").distinct()
    return cams.select("cam", F.explode(F.sequence(F.lit(0), F.lit(PER_CAMERA - 1))).alias("frame_idx")).withColumn("mono_ts", F.col("frame_idx") / FPS)


FRAMES = f"(select cam, frame_idx, frame_idx / cast(5 as double) as mono_ts from (select distinct cam from {DETECTIONS}), (select unnest(range(1000))::int as frame_idx))"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both subjects of a frame in one row: x1..y2 and ox1..oy2."""
    rows = detections(spark, sf_dir)
    other = rows.filter("slot = 2").select("cam", "frame_idx", *(F.col(c).alias(f"o{c}") for c in Box._fields))
    # the second subject is moved over the first, so that many overlap
    other = other.withColumns({"ox1": F.col("ox1") - 600, "ox2": F.col("ox2") - 600})
    return rows.filter("slot = 1").join(other, ["cam", "frame_idx"])


PAIRS = f"(select a.*, b.x1 - 600 as ox1, b.y1 as oy1, b.x2 - 600 as ox2, b.y2 as oy2 from {DETECTIONS} a join {DETECTIONS} b on a.cam = b.cam and a.frame_idx = b.frame_idx and a.slot = 1 and b.slot = 2)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior events: camera by user, one source per camera parity, ends after value seconds; some without an end."""
    e = table(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    kind = F.col("event_type")
    end = F.when(F.col("event_id") % 11 != 0, start + F.col("value"))
    labeled = F.col("event_id") % 5 == 0
    key = F.col("event_id").cast("long")
    return e.select(
        key.alias("event_key"), (F.col("user_id") % 20).cast("string").alias("camera_id"), F.when(key % 97 == 0, "").otherwise(F.concat(F.lit("src"), (F.col("user_id") % 3).cast("string"))).alias("source_id"),
        start.alias("start_s"), end.alias("end_s"), F.when(key % 4 == 0, (key % 1000).cast("double")).alias("source_start_s"), F.when(key % 4 == 0, (key % 1000).cast("double") + 2.5).alias("source_end_s"),
        F.when(key % 13 == 0, F.concat(F.lit("p"), (key % 500).cast("string"))).alias("provider_id"), F.concat(F.lit("e"), F.lpad(key.cast("string"), 8, "0")).alias("dir_name"), F.concat(F.lit("id"), key.cast("string")).alias("event_id"),
        F.when(labeled, F.when(kind.isin("click", "view"), "pee").otherwise("poop")).otherwise("unknown").alias("label"), F.when(labeled, "labeled").otherwise("unlabeled").alias("label_status"),
        F.when(labeled & (key % 2 == 0), "gromit").alias("name"), F.when(key % 15 == 0, "seen").alias("label_note"), F.when(labeled, F.concat(F.lit("2024-01-"), F.lpad((key % 28 + 1).cast("string"), 2, "0"))).alias("labeled_at"),
        F.when(key % 3 != 0, start + 60).alias("recorded_s"), (start + 120).alias("modified_s"), (key % 5000 + 100).alias("bytes"), kind.alias("event_type"), F.col("value"),
    )


EVENTS = """(select event_id::bigint as event_key, (user_id % 20)::varchar as camera_id, case when event_id % 97 = 0 then '' else 'src' || (user_id % 3)::varchar end as source_id,
  epoch_us(ts) / 1e6::double as start_s, case when event_id % 11 <> 0 then epoch_us(ts) / 1e6::double + value end as end_s,
  case when event_id % 4 = 0 then (event_id % 1000)::double end as source_start_s, case when event_id % 4 = 0 then (event_id % 1000)::double + 2.5::double end as source_end_s,
  case when event_id % 13 = 0 then 'p' || (event_id % 500)::varchar end as provider_id, 'e' || lpad(event_id::varchar, 8, '0') as dir_name, 'id' || event_id::varchar as event_id,
  case when event_id % 5 = 0 then case when event_type in ('click', 'view') then 'pee' else 'poop' end else 'unknown' end as label, case when event_id % 5 = 0 then 'labeled' else 'unlabeled' end as label_status,
  case when event_id % 10 = 0 then 'gromit' end as name, case when event_id % 15 = 0 then 'seen' end as label_note, case when event_id % 5 = 0 then '2024-01-' || lpad((event_id % 28 + 1)::varchar, 2, '0') end as labeled_at,
  case when event_id % 3 <> 0 then epoch_us(ts) / 1e6::double + 60 end as recorded_s, epoch_us(ts) / 1e6::double + 120 as modified_s, event_id % 5000 + 100 as bytes, event_type, value from events)"""


def new_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rerun: every third event, its start a little later."""
    rows = events(spark, sf_dir).filter("event_key % 3 = 0")
    return rows.withColumns({"start_s": F.col("start_s") + F.col("event_key") % 7, "seq": F.col("event_key"), "label": F.lit("unknown"), "label_status": F.lit("unlabeled"), **{c: F.lit(None).cast("string") for c in ("name", "label_note", "labeled_at")}}).withColumn("event_key", F.col("event_key") + 1_000_000_000)


NEW_EVENTS = f"(select * replace (start_s + event_key % 7 as start_s, event_key + 1000000000 as event_key), event_key as seq from {EVENTS} where event_key % 3 = 0)"


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 8).cast("int").alias("source"), (F.col("l_orderkey") / F.lit(10.0)).alias("pts_time"), F.col("l_quantity").cast("int").alias("size"), (F.col("l_returnflag") == "R").alias("is_keyframe"))


PACKETS = "(select (l_suppkey % 8)::int as source, l_orderkey / cast(10 as double) as pts_time, l_quantity::int as size, l_returnflag = 'R' as is_keyframe from lineitem)"


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets(spark, sf_dir).groupBy("source").agg((F.floor(F.max("pts_time")).cast("int") + 1).alias("duration_s"))


DURATIONS = f"(select source, floor(max(pts_time))::int + 1 as duration_s from {PACKETS} group by source)"


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds with a big packet."""
    return packets(spark, sf_dir).filter("size >= 48").select("source", F.floor("pts_time").cast("int").alias("second")).distinct()


TRUTH = f"(select distinct source, floor(pts_time)::int as second from {PACKETS} where size >= 48)"


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clip for each camera; every third has uneven frame times."""
    times = F.transform(F.sequence(F.lit(0), F.lit(PER_CAMERA - 1)), lambda i: F.round(i / FPS + i % 7 / F.lit(100.0) * (i > 0).cast("int"), 9))
    cams = detections(spark, sf_dir).select("cam").distinct()
    return cams.select(
        F.col("cam").alias("clip"), F.lit(FPS).alias("fps"), F.lit(PER_CAMERA).alias("frame_count"), F.when(F.col("cam") % 3 == 0, times).alias("frame_times_s"), F.concat(F.lit("cam"), F.col("cam").cast("string"), F.lit("@x")).alias("source_id"),
        F.concat(F.lit("2024-02-"), F.lpad((F.col("cam") % 28 + 1).cast("string"), 2, "0")).alias("day"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"),
    )


CLIPS = f"""(select cam as clip, 5::double as fps, 1000 as frame_count, case when cam % 3 = 0 then [round(i / 5::double + (i % 7) / 100::double, 9) for i in range(1000)] end as frame_times_s,
  'cam' || cam::varchar || '@x' as source_id, '2024-02-' || lpad((cam % 28 + 1)::varchar, 2, '0') as day, 1280 as width, 720 as height from (select distinct cam from {DETECTIONS}))"""


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label ranges: the blocks of frames of the first subject, behaviour by block."""
    blk = F.floor(F.col("frame_idx") / BLOCK).cast("int")
    by = detections(spark, sf_dir).filter("slot = 1").groupBy(F.col("cam").alias("clip"), blk.alias("blk")).agg(F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("blk") % 4 + 1)
    return by.select("clip", "blk", "start_frame", "end_frame", (F.col("start_frame") / FPS).alias("start_s"), (F.col("end_frame") / FPS).alias("end_s"), pick(("pee", "poop", "not_potty", "excluded")).alias("behavior"), pick(("gromit", "walle", "unknown", "unknown")).alias("name"), F.when(F.col("blk") % 5 != 0, "1").alias("track_id"))


RANGES = f"""(select clip, blk, start_frame, end_frame, start_frame / 5::double as start_s, end_frame / 5::double as end_s, ['pee','poop','not_potty','excluded'][blk % 4 + 1] as behavior,
  ['gromit','walle','unknown','unknown'][blk % 4 + 1] as name, case when blk % 5 <> 0 then '1' end as track_id
  from (select cam as clip, cast(floor(frame_idx / 60) as int) as blk, min(frame_idx) as start_frame, max(frame_idx) as end_frame from {DETECTIONS} where slot = 1 group by 1, 2))"""
