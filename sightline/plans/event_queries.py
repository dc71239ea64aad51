"""Queries over events: reruns, upkeep, review, pre-filters, telemetry, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.boxes import Box
from ..operators import events, labels, maintenance, poses, prefilter, ranks, reconcile
from . import views
from .registry import query, r6

E, N, D, C, R, PK, DU, TR = views.EVENTS, views.NEW_EVENTS, views.DETECTIONS, views.CLIPS, views.RANGES, views.PACKETS, views.DURATIONS, views.TRUTH
IDENTIFIED = "source_id <> '' and camera_id <> ''"


@query(f"select camera_id, source_id, count(*) as n from {E} where {IDENTIFIED} group by 1, 2")
def a2_identified_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.identified(views.events(spark, sf_dir)).groupBy("camera_id", "source_id").agg(F.count("*").alias("n"))


MATCHES = f"""(with n as (select * from {N} where {IDENTIFIED}), p as (select * from {E} where {IDENTIFIED}),
c as (select n.event_key as new_key, p.event_key as prior_key, abs(n.start_s - p.start_s) as apart, p.dir_name, coalesce(n.provider_id = p.provider_id and n.provider_id <> '', false) as exact,
  coalesce(p.provider_id, '') = '' or p.provider_id is not distinct from n.provider_id as fair,
  coalesce(n.source_start_s <= p.source_end_s and p.source_start_s <= n.source_end_s, false) or coalesce(n.start_s <= p.end_s and p.start_s <= n.end_s, false) or abs(n.start_s - p.start_s) <= 5 as near
  from n join p on n.camera_id = p.camera_id and n.source_id = p.source_id),
k as (select *, bool_or(exact) over (partition by new_key) as any_exact from c)
select new_key, prior_key, row_number() over (partition by new_key order by apart, dir_name) as rank from k where case when any_exact then exact else near and fair end)"""


@query(f"select * from {MATCHES}")
def f2_rerun_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.matches(views.new_events(spark, sf_dir), views.events(spark, sf_dir), 5.0)


@query(f"select new_key, prior_key from {MATCHES} where rank = 1")
def f3_closest_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.closest(views.new_events(spark, sf_dir), views.events(spark, sf_dir), 5.0)


@query(f"""with g as (select m.new_key, m.rank, p.* from {MATCHES} m join {E} p on m.prior_key = p.event_key),
k as (select new_key, count(*) as n, count(case when label_status <> 'unlabeled' then 1 end) as n_labeled, count(distinct case when label_status <> 'unlabeled' then label || '|' || coalesce(name, '') || '|' || coalesce(label_note, '') end) as kinds,
  arg_min(event_id, rank) as closest, arg_max(event_id, labeled_at || lpad((100000 - rank)::varchar, 6, '0')) filter (label_status <> 'unlabeled') as best, arg_max(label, labeled_at || lpad((100000 - rank)::varchar, 6, '0')) filter (label_status <> 'unlabeled') as best_label from g group by 1)
select new_key, n, kinds > 1 as conflict, case when kinds <= 1 then case when n_labeled > 0 then best else closest end end as event_id, case when kinds = 1 then best_label end as carried_label from k""")
def h12_label_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reconcile.carry(views.new_events(spark, sf_dir), views.events(spark, sf_dir), 5.0)
    return found.select("new_key", "n", "conflict", "event_id", "carried_label")


CLUSTERS = f"""(with recursive r as (select *, coalesce(end_s, start_s) as e, row_number() over (partition by camera_id, source_id order by start_s, event_key) as n from {E} where {IDENTIFIED}),
f as (select camera_id, source_id, n, event_key, 0 as cluster, start_s as anchor, e as reach from r where n = 1
  union all
  select r.camera_id, r.source_id, r.n, r.event_key, case when joins then f.cluster else f.cluster + 1 end, case when joins then f.anchor else r.start_s end, case when joins then greatest(f.reach, r.e) else r.e end
  from f join r on r.camera_id = f.camera_id and r.source_id = f.source_id and r.n = f.n + 1, lateral (select r.start_s <= f.reach or r.start_s - f.anchor <= 60 as joins))
select event_key, camera_id, source_id, cluster from f)"""


@query(f"select * from {CLUSTERS}")
def h7_rerun_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.intervals import anchored_clusters

    rows = reconcile.identified(views.events(spark, sf_dir))
    return anchored_clusters(rows, reconcile.KEYS, "start_s", "end_s", 60.0, "event_key").select("event_key", "camera_id", "source_id", "cluster")


# One row for each labelled state that rows of a group agree on; rank 1 first. Of equal times the first rank wins.
LABELED = "label_status <> 'unlabeled'"
LATEST = "coalesce(labeled_at, '') || lpad((100000 - rank)::varchar, 6, '0')"
DECISION = f"""count(case when {LABELED} then 1 end) as n_labeled, count(distinct case when {LABELED} then label || '|' || coalesce(name, '') || '|' || coalesce(label_note, '') end) as kinds,
  arg_max(label, {LATEST}) filter ({LABELED}) as best_label, arg_max(label_status, {LATEST}) filter ({LABELED}) as best_status, arg_max(event_id, {LATEST}) filter ({LABELED}) as best_id, arg_min(event_id, rank) as closest_id"""
PLAN = f"""(with c as (select e.*, c.cluster, count(*) over (partition by e.camera_id, e.source_id, c.cluster) as size, row_number() over (partition by e.camera_id, e.source_id, c.cluster order by e.start_s, e.event_key) as rank
  from {CLUSTERS} c join {E} e using (event_key)),
d as (select camera_id, source_id, cluster, {DECISION} from c where size > 1 group by 1, 2, 3),
k as (select *, row_number() over (partition by camera_id, source_id, cluster order by coalesce(recorded_s, modified_s, -1e18) desc, rank) as newest from c where size > 1),
p as (select k.event_key, k.cluster, first_value(k.event_key) over (partition by k.camera_id, k.source_id, k.cluster order by k.newest) as keeper_key, d.kinds, case when d.n_labeled > 0 and d.kinds <= 1 then best_label end as carried_label,
  case when d.n_labeled > 0 and d.kinds <= 1 then best_status end as carried_status from k join d using (camera_id, source_id, cluster))
select event_key, cluster, keeper_key, case when kinds > 1 then 'conflict' when event_key = keeper_key then 'keep' else 'remove' end as action, carried_label, carried_status from p)"""


@query(f"select event_key, cluster, keeper_key, action, carried_label from {PLAN}")
def m1_collapse_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.collapse_plan(views.events(spark, sf_dir), 60.0).select("event_key", "cluster", "keeper_key", "action", "carried_label")


@query(f"""select e.event_key, case when p.action = 'keep' and carried_status is not null then carried_label else e.label end as label,
  case when p.action = 'keep' and carried_status is not null then carried_status else e.label_status end as label_status from {E} e left join {PLAN} p using (event_key) where coalesce(p.action, '') <> 'remove'""")
def m1_collapsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.events(spark, sf_dir)
    return reconcile.collapsed(rows, reconcile.collapse_plan(rows, 60.0)).select("event_key", "label", "label_status")


@query(f"""with w as (select m.new_key, m.prior_key, m.rank as r, row_number() over (partition by m.prior_key order by n.seq, m.new_key) as claim from {MATCHES} m join {N} n on n.event_key = m.new_key),
g as (select w.new_key, row_number() over (partition by w.new_key order by w.r) as rank, p.* from w join {E} p on p.event_key = w.prior_key where claim = 1),
d as (select new_key, {DECISION} from g group by 1)
select event_key, event_id, label, label_status from {E} where event_key not in (select g.event_key from g join d using (new_key) where kinds <= 1)
union all
select n.event_key, coalesce(case when kinds <= 1 then case when n_labeled > 0 then best_id else closest_id end end, n.event_id), coalesce(case when kinds = 1 then best_label end, 'unknown'), coalesce(case when kinds = 1 then best_status end, 'unlabeled')
from {N} n left join d on d.new_key = n.event_key""")
def k7_recorded_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.recorded(views.new_events(spark, sf_dir), views.events(spark, sf_dir), 5.0).select("event_key", "event_id", "label", "label_status")


PATH = "'/video/' || (event_key % 40)::varchar || '.mp4'"
STATES = f"""(select event_key, bytes, case when label_status <> 'unlabeled' or label <> 'unknown' or coalesce(name, '') <> '' or coalesce(label_note, '') <> '' then 'labeled'
  when end_s is not null or (event_key % 3 <> 0) then 'deterministic' when event_key % 40 >= 30 then 'source_missing' else 'removable' end as state from {E})"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/video/"), (F.col("event_key") % 40).cast("string"), F.lit(".mp4"))
    rows = views.events(spark, sf_dir).withColumns({"source_path": F.when(F.col("event_key") % 2 == 0, path), "sanitized_source_id": F.concat(F.lit("file://"), path)})
    listing = rows.select((F.col("event_key") % 40).alias("n")).distinct().filter("n < 30").select(F.concat(F.lit("/video/"), F.col("n").cast("string"), F.lit(".mp4")).alias("path"))
    return maintenance.states(rows, listing)


@query(f"select event_key, event_key % 40 < 30 as source_exists from {E}")
def f8_source_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("event_key", "source_exists")


@query(f"select event_key, state from {STATES}")
def d8_event_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("event_key", "state")


@query(f"select state, count(*) as n from {STATES} group by 1")
def g17_cleanup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


@query(f"select event_key, state = 'removable' as trashed from {STATES}")
def m2_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    stay, gone = maintenance.quarantined(classified(spark, sf_dir), "20240101T000000Z")
    return stay.select("event_key", F.lit(False).alias("trashed")).unionByName(gone.select("event_key", F.lit(True).alias("trashed")))


@query(f"select count(*) as removable, 0 as touched from {STATES} where state = 'removable'")
def f13_protected_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, gone = maintenance.quarantined(classified(spark, sf_dir), "20240101T000000Z")
    return gone.agg(F.count("*").alias("removable"), F.count_if(F.col("label_status") != "unlabeled").alias("touched"))


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    cams = views.events(spark, sf_dir).select("camera_id").distinct()
    n = F.col("camera_id").cast("int")
    return cams.select("camera_id", F.lit(10).alias("retention_days"), F.when(n % 3 != 0, 200_000 + n * 10_000).alias("max_bytes"))


NOW = f"(select max(modified_s) as now from {E})"
RETENTION = f"""(with e as (select *, modified_s < now - 10 * 86400 as old, case when camera_id::int % 3 <> 0 then 200000 + camera_id::int * 10000 end as cap from {E}, {NOW}),
w as (select *, sum(case when old then 0 else bytes end) over (partition by camera_id) as total, coalesce(sum(case when old then 0 else bytes end) over (partition by camera_id order by modified_s, event_key rows between unbounded preceding and 1 preceding), 0) as before from e)
select event_key, camera_id, bytes, case when old then 'age' when cap is not null and total - before > cap then 'size' end as reason from w)"""


def retention(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = views.events(spark, sf_dir)
    now = rows.agg(F.max("modified_s")).first()[0]
    return rows, maintenance.retention_plan(rows, cameras(spark, sf_dir), now)


@query(f"select event_key, reason from {RETENTION}")
def h13_retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention(spark, sf_dir)[1].select("event_key", "reason")


@query(f"select camera_id, count(reason) as deleted, sum(case when reason is not null then bytes else 0 end)::bigint as deleted_bytes, sum(case when reason is null then bytes else 0 end)::bigint as remaining_bytes from {RETENTION} group by 1")
def m4_retention_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.retained(*retention(spark, sf_dir))[1]


@query(f"""select event_key, case when event_key % 6 = 0 then case when event_key % 12 = 0 then 'pee' else 'not_potty' end else label end as label, case when event_key % 6 = 0 then 'labeled' else label_status end as label_status,
  case when event_key % 12 = 0 then 'apollo' else name end as name, case when event_key % 18 = 0 then 'new note' else label_note end as label_note from {E}""")
def m3_label_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.events(spark, sf_dir)
    k = F.col("event_key")
    base = rows.filter(k % 6 == 0).select("event_key")
    second = base.select("event_key", F.when(k % 12 == 0, "pee").otherwise("not_potty").alias("label"), F.lit("labeled").alias("label_status"), (k % 12 == 0).alias("has_name"), F.lit(" apollo ").alias("name"), F.when(k % 18 == 0, "new note").alias("label_note"), F.lit("2024-03-02").alias("labeled_at"))
    first = base.select("event_key", F.lit("poop").alias("label"), F.lit("uncertain").alias("label_status"), F.lit(False).alias("has_name"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("label_note"), F.lit("2024-03-01").alias("labeled_at"))
    wrong = first.withColumn("label", F.lit("cat"))
    good, _ = maintenance.label_updates(first.unionByName(second).unionByName(wrong), ["apollo", "gromit"])
    return maintenance.updated(rows, good).select("event_key", "label", "label_status", "name", "label_note")


# --- review


def reviewable(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_micros((F.col("start_s") * 1e6).cast("long"))
    return views.events(spark, sf_dir).withColumns({"camera_dir": F.concat(F.lit("Cam_"), F.col("camera_id")), "camera_name": F.concat(F.lit("Cam "), F.col("camera_id")), "date_dir": F.date_format(at, "yyyy-MM-dd"), "utc_ts": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")})


@query(f"select event_key from {E} where camera_id = '7' and label_status = 'unlabeled'")
def e4_review_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.reviewed(reviewable(spark, sf_dir), "CAM 7").select("event_key")


@query(f"select event_key from {E} order by start_s desc, dir_name desc limit 50 offset 20")
def i1_newest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.page(views.events(spark, sf_dir), 50, 20).select("event_key")


@query(f"select count(*) as total, count(case when camera_id = '7' then 1 end) as filtered from {E}")
def g16_review_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.totals(views.events(spark, sf_dir), F.col("camera_id") == "7")


@query(f"select event_key from (select event_key, row_number() over (partition by event_key % 1000 order by start_s desc, dir_name desc) as r from {E}) where r = 1")
def i5_first_event_per_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.events(spark, sf_dir).withColumn("event_id", (F.col("event_key") % 1000).cast("string"))
    return events.newest_per_id(rows).select("event_key")


@query(f"select event_key from {E} where event_key % 4 <> 0")
def j4_unseen_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.events(spark, sf_dir)
    return events.unseen(rows, rows.filter("event_key % 4 = 0").select("event_id")).select("event_key")


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_key")
    rows = views.events(spark, sf_dir).select("event_key", F.explode(F.sequence(F.lit(0), (k % 4).cast("int"))).alias("i"))
    return rows.select("event_key", F.when((F.col("i") % 2 == 0) | (k % 5 == 0), "frames").otherwise("crops").alias("kind"), F.concat(F.lpad(F.col("i").cast("string"), 3, "0"), F.lit(".jpg")).alias("name"))


MEDIA = f"(select event_key, case when i % 2 = 0 or event_key % 5 = 0 then 'frames' else 'crops' end as kind, lpad(i::varchar, 3, '0') || '.jpg' as name from (select event_key, unnest(range(event_key % 4 + 1)) as i from {E}))"


@query(f"""select event_key, kind, count(*) as n, min(name) as first_name, string_agg(name, ',' order by name) as names, any_value(thumb) as thumbnail from
(select *, coalesce(min(case when kind = 'crops' then name end) over (partition by event_key), min(case when kind = 'frames' then name end) over (partition by event_key)) as thumb from {MEDIA}) group by 1, 2""")
def a8_media_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.media_summary(media(spark, sf_dir)).withColumn("names", F.array_join("names", ","))


@query(f"""with c as (select camera_id, event_key, start_s, coalesce(end_s, start_s) as e from {E}),
f as (select *, case when start_s > max(e) over (partition by camera_id order by start_s, e, event_key rows between unbounded preceding and 1 preceding) then 1 else 0 end as fresh from c),
s as (select *, sum(fresh) over (partition by camera_id order by start_s, e, event_key rows unbounded preceding) as scene from f),
z as (select *, count(*) over (partition by camera_id, scene) as size from s)
select event_key as span_id, case when size > 1 then camera_id || '#' || scene::bigint::varchar end as scene_id, size as scene_size from z""")
def h6_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.events(spark, sf_dir).select(F.col("camera_id").alias("camera"), F.col("event_key").alias("span_id"), "start_s", "end_s")
    return events.scenes(rows).select("span_id", "scene_id", "scene_size")


@query(f"select cam, string_agg(class_name || ':' || n::varchar, ',' order by n desc, class_name) as classes from (select cam, class_name, count(*) as n from {D} group by 1, 2) group by 1")
def g7_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.class_counts(views.detections(spark, sf_dir), ["cam"])
    return rows.select("cam", F.array_join(F.transform("classes", lambda c: F.concat(c["class_name"], F.lit(":"), c["count"].cast("string"))), ",").alias("classes"))


SUMMARIES = f"""(select c.clip, round(case when frame_times_s is null then frame_count / fps else frame_times_s[-1] + greatest(0, frame_times_s[-1] - frame_times_s[-2]) end, 3) as duration_s, d.n as n_detections, r.n as n_ranges, r.t as n_trainable, r.b as behaviors, r.t > 0 as labeled
  from {C} c join (select cam, count(*) as n from {D} group by 1) d on d.cam = c.clip join (select clip, count(*) as n, count(case when behavior <> 'excluded' then 1 end) as t, string_agg(distinct behavior, ',' order by behavior) as b from {R} group by 1) r on r.clip = c.clip)"""


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.clip_summaries(views.clips(spark, sf_dir), views.detections(spark, sf_dir).withColumnRenamed("cam", "clip"), views.ranges(spark, sf_dir))


@query(f"select * from {SUMMARIES}")
def g8_clip_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(spark, sf_dir).select("clip", "duration_s", "n_detections", "n_ranges", "n_trainable", F.array_join("behaviors", ",").alias("behaviors"), "labeled")


@query(f"select clip, row_number() over (order by clip % 2, clip % 5 desc, clip) as place from {C}")
def i2_label_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.clips(spark, sf_dir).select("clip", F.col("clip").alias("span_id"), (F.col("clip") % 2 == 1).alias("labeled"), (F.col("clip") % 5).cast("double").alias("start_s"))
    return ranks.placed(events.label_queue(rows), "labeled", F.col("start_s").desc_nulls_last(), "span_id").select("clip", "place")


@query(f"""with c as (select clip, (clip // 3)::int as camera, (clip % 3) * 100::double as start_s from {C}), b as (select cam as clip, slot, frame_idx, (cam % 3) * 100 + mono_ts as at_s from {D})
select c.clip as span_id, b.clip as sibling_id, b.slot::varchar as track_id, b.frame_idx as own_frame, least(999, round_even((at_s - c.start_s) * 5, 0))::bigint as frame_idx from c join c s on s.camera = c.camera and s.clip <> c.clip join b on b.clip = s.clip
where at_s - c.start_s >= -1e-9 and at_s - c.start_s <= 200 + 1e-9""")
def f9_sibling_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    clip = F.col("clip")
    own = views.clips(spark, sf_dir).select(F.floor(clip / 3).cast("int").alias("camera"), clip.alias("span_id"), ((clip % 3) * 100).cast("double").alias("span_start_s"), F.lit(200.0).alias("duration_s"), "fps", "frame_count")
    seen = views.detections(spark, sf_dir).select(F.col("cam").alias("span_id"), F.concat_ws("/", F.col("slot").cast("string"), F.col("frame_idx").cast("string")).alias("track_id"), ((F.col("cam") % 3) * 100 + F.col("mono_ts")).alias("at_s"))
    rows = events.siblings(own, seen)
    return rows.select("span_id", "sibling_id", F.split("track_id", "/")[0].alias("track_id"), F.split("track_id", "/")[1].cast("int").alias("own_frame"), "frame_idx")


# --- pre-filters

CURVE = f"(select s.source, s.second, coalesce(e.energy, 0) as energy from (select source, unnest(range(duration_s))::int as second from {DU}) s left join (select source, trunc(pts_time)::int as second, sum(size)::double as energy from {PK} where not is_keyframe group by 1, 2) e using (source, second))"


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefilter.energy(views.packets(spark, sf_dir), views.durations(spark, sf_dir))


@query(f"select * from {CURVE}")
def g1_second_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve(spark, sf_dir)


CHOSEN = f"(select source, second from (select *, max(energy) over (partition by source) as peak from {CURVE}) where energy > 0 and energy >= 0.3::double * peak)"


@query(f"select * from {CHOSEN}")
def g2_threshold_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefilter.over_threshold(curve(spark, sf_dir), 0.3)


@query(f"select cam as source, second from (select cam, floor(frame_idx / 5::double)::int as second, count(distinct frame_idx) as n from {D} group by 1, 2) where n >= 5")
def g3_presence_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = prefilter.frame_presence(views.detections(spark, sf_dir), ["cam", "frame_idx"])
    return prefilter.presence(frames.select(F.col("cam").alias("source"), "frame_idx", F.lit(views.FPS).alias("fps"), "has_box"), 5)


DILATED = f"(select distinct source, unnest(range(greatest(0, second - 2), least(duration_s - 1, second + 2) + 1))::int as second from {CHOSEN} join {DU} using (source))"


@query(f"select * from {DILATED}")
def h8_dilated_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefilter.dilated(prefilter.over_threshold(curve(spark, sf_dir), 0.3), views.durations(spark, sf_dir), 2)


RATIOS = """round(case when true_seconds > 0 then hits / true_seconds::double else 1 end, 4) as recall, round(case when selected_seconds > 0 then hits / selected_seconds::double when true_seconds = 0 then 1 else 0 end, 4) as precision,
  round(1 - case when duration_s > 0 then selected_seconds / duration_s::double else 0 end, 4) as compute_saved, true_seconds - hits as missed_seconds"""
COUNTS = f"""(select d.source, d.duration_s::bigint as duration_s, (select count(*) from {TR} t where t.source = d.source) as true_seconds, (select count(*) from {DILATED} x where x.source = d.source) as selected_seconds,
  (select count(*) from {DILATED} x join {TR} t using (source, second) where x.source = d.source) as hits from {DU} d)"""


def scored(spark: SparkSession, sf_dir: str, per: str) -> DataFrame:
    chosen = h8_dilated_seconds(spark, sf_dir).withColumn("strategy", F.lit("motion"))
    found = prefilter.scores(chosen, views.truth(spark, sf_dir), views.durations(spark, sf_dir), spark.createDataFrame([("motion",)], "strategy string"), per)
    return found.withColumns({c: F.round(c, 4) for c in ("recall", "precision", "compute_saved")}).drop("selected_fraction")


@query(f"select 'motion' as strategy, source, duration_s, true_seconds, selected_seconds, hits, {RATIOS} from {COUNTS}")
def g4_strategy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, "source")


@query(f"select 'motion' as strategy, duration_s, true_seconds, selected_seconds, hits, {RATIOS} from (select sum(duration_s)::bigint as duration_s, sum(true_seconds)::bigint as true_seconds, sum(selected_seconds)::bigint as selected_seconds, sum(hits)::bigint as hits from {COUNTS})")
def g5_score_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, "total")


GRID = "(values ('motion>=0.1', 0.1::double), ('motion>=0.3', 0.3::double)) g(strategy, fraction)"
SWEEP = f"""(with p as (select g.strategy, c.source, c.second, c.energy, fraction, max(energy) over (partition by g.strategy, c.source) as peak from {CURVE} c, {GRID}),
x as (select distinct strategy, source, unnest(range(greatest(0, second - 1), least(duration_s - 1, second + 1) + 1))::int as second from p join {DU} using (source) where energy > 0 and energy >= fraction * peak),
a as (select * from x union all select 'all', source, unnest(range(duration_s))::int from {DU}),
k as (select a.strategy, a.source, count(*) as selected_seconds, count(t.second) as hits from a left join {TR} t using (source, second) group by 1, 2),
e as (select s.strategy, d.source, d.duration_s::bigint as duration_s, (select count(*) from {TR} t where t.source = d.source) as true_seconds, coalesce(k.selected_seconds, 0) as selected_seconds, coalesce(k.hits, 0) as hits
  from {DU} d cross join (select strategy from {GRID} union all select 'all') s left join k on k.source = d.source and k.strategy = s.strategy)
select * from e union all select strategy, null, sum(duration_s)::bigint, sum(true_seconds)::bigint, sum(selected_seconds)::bigint, sum(hits)::bigint from e group by 1)"""


@query(f"select strategy, coalesce(source, -1) as source, duration_s, true_seconds, selected_seconds, hits, {RATIOS} from {SWEEP}")
def g6_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefilter.bakeoff(views.packets(spark, sf_dir), views.truth(spark, sf_dir), views.durations(spark, sf_dir), (0.1, 0.3), 1)
    return found.withColumns({c: F.round(c, 4) for c in ("recall", "precision", "compute_saved")} | {"source": F.coalesce("source", F.lit(-1))}).drop("selected_fraction")


@query(f"select source, second from {CHOSEN} union select source, second from {TR}")
def j1_union_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefilter.over_threshold(curve(spark, sf_dir), 0.3).unionByName(views.truth(spark, sf_dir)).distinct()


@query(f"select source, second, true as hit from (select source, second from {CHOSEN} intersect select source, second from {TR}) union all select source, second, false from (select source, second from {TR} except select source, second from {CHOSEN})")
def j2_hits_and_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, real = prefilter.over_threshold(curve(spark, sf_dir), 0.3), views.truth(spark, sf_dir)
    return real.intersect(chosen).withColumn("hit", F.lit(True)).unionByName(real.exceptAll(chosen).withColumn("hit", F.lit(False)))


@query(f"select source, count(*) as n_all, (select count(*) from {TR} t where t.source = s.source) as n_clamped from (select source, unnest(range(duration_s)) from {DU}) s group by source")
def j3_second_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.durations(spark, sf_dir)
    truth = views.truth(spark, sf_dir)
    outside = truth.withColumn("second", -F.col("second") - 1)
    held = prefilter.clamped(truth.unionByName(outside), d).groupBy("source").agg(F.count("*").alias("n_clamped"))
    return prefilter.all_seconds(d).groupBy("source").agg(F.count("*").alias("n_all")).join(held, "source")


# --- telemetry

OUTCOMES = ("success", "skip_tiny_crop", "build_failed", "infer_error", "infer_none", "bad_shape", "no_finite_keypoints")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_key")
    outcome = F.element_at(F.array(*map(F.lit, OUTCOMES)), (k % 7 + 1).cast("int"))
    return views.events(spark, sf_dir).select(F.col("camera_id").alias("source"), F.col("start_s").alias("ts"), k.alias("call_id"), outcome.alias("outcome"), F.when(k % 7 != 2, F.col("value")).alias("latency_ms"), (k % 100 / F.lit(100.0)).alias("mean_conf"), (k % 50 / F.lit(50.0)).alias("frac_ge"), (k % 39).cast("double").alias("n_keypoints"))


@query(f"""with c as (select camera_id as source, start_s, event_key, event_key % 7 as o, case when event_key % 7 <> 2 then value end as ms from {E}),
l as (select source, ms, row_number() over (partition by source order by start_s desc, event_key desc) as r from c where ms is not null),
p as (select source, quantile_cont(ms, 0.5) as p50, quantile_cont(ms, 0.95) as p95, quantile_cont(ms, 0.99) as p99 from l where r <= 200 group by 1)
select source, count(*) as total_calls, count(case when o = 0 then 1 end) as n_success, count(case when o = 3 then 1 end) as n_infer_error, count(ms) as latency_count, round(avg(ms), 6) as latency_mean, min(ms) as latency_min, max(ms) as latency_max,
  round(any_value(p50), 6) as latency_p50, round(any_value(p95), 6) as latency_p95, round(any_value(p99), 6) as latency_p99, round(avg(case when o = 0 then event_key % 100 / 100::double end), 6) as mean_mean_conf from c join p using (source) group by source""")
def g14_pose_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = poses.telemetry(calls(spark, sf_dir), 200)
    return found.select("source", "total_calls", "n_success", "n_infer_error", "latency_count", r6("latency_mean").alias("latency_mean"), "latency_min", "latency_max", *(r6(f"latency_p{p}").alias(f"latency_p{p}") for p in (50, 95, 99)), r6("mean_mean_conf").alias("mean_mean_conf"))


@query(f"""with f as (select camera_id as source, event_key // 32 as batch, value as ms, event_key % 3 as boxes from {E}), b as (select source, batch, count(*) as size from f group by 1, 2), s as (select source, count(*) as batches, round(avg(size), 6) as mean_batch, max(size) as max_batch from b group by 1)
select source, count(*) as frames, sum(boxes)::bigint as boxes, round(avg(ms), 6) as mean_latency_ms, round(quantile_cont(ms, 0.95), 6) as p95_latency_ms, any_value(batches) as batches, any_value(mean_batch) as mean_batch, any_value(max_batch) as max_batch, round(count(*) * 1000 / sum(ms), 6) as fps from f join s using (source) group by source""")
def g15_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_key")
    frames = views.events(spark, sf_dir).select(F.col("camera_id").alias("source"), F.floor(k / 32).alias("batch"), F.col("value").alias("latency_ms"), (k % 3).alias("n_boxes"))
    return poses.run_summary(frames).withColumns({c: r6(c) for c in ("mean_latency_ms", "p95_latency_ms", "mean_batch", "fps")})


# --- labels


@query(f"select count(*) as kept, (select count(*) from {R} where behavior = 'excluded') as excluded from {R} where behavior <> 'excluded'")
def e5_trainable_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = keys.is_trainable(F.col("behavior"))
    return views.ranges(spark, sf_dir).agg(F.count_if(fine).alias("kept"), F.count_if(~fine).alias("excluded"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.sampled(views.ranges(spark, sf_dir), views.clips(spark, sf_dir), 1.6, 10)
    return rows.withColumn("sample_id", F.concat_ws("/", "clip", "blk", "frame_idx"))


SAMPLES = f"""(with s as (select *, range(start_frame, end_frame + 1, 8) as f from {R} where clip % 3 <> 0 and behavior <> 'excluded')
select clip, blk, behavior, name, track_id, unnest(f) as frame_idx from s)"""
NEAREST = f"""(select s.*, r.x1 as rx1, r.y1 as ry1, r.x2 as rx2, r.y2 as ry2 from {SAMPLES} s left join lateral (select * from {D} d where d.cam = s.clip and d.slot::varchar = s.track_id and d.frame_idx % 6 = 0 order by abs(d.frame_idx - s.frame_idx), d.frame_idx limit 1) r on true)"""


def referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = views.detections(spark, sf_dir).select(F.col("cam").alias("clip"), F.col("slot").cast("string").alias("track_id"), F.col("frame_idx").alias("ref_idx"), *Box._fields)
    return labels.with_reference(samples(spark, sf_dir), refs)


@query(f"select clip, blk, frame_idx, rx1 as x1, ry2 as y2 from {NEAREST}")
def f4_nearest_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return referenced(spark, sf_dir).select("clip", "blk", "frame_idx", F.col("reference.x1").alias("x1"), F.col("reference.y2").alias("y2"))


PICK_IOU = "case when s > 0 then s / (greatest(x2-x1,0)*greatest(y2-y1,0) + greatest(rx2-rx1,0)*greatest(ry2-ry1,0) - s) else 0 end"
PICKED = f"""(with j as (select n.*, d.slot, d.x1, d.y1, d.x2, d.y2, d.confidence, d.det_rank, greatest(least(x2,rx2)-greatest(x1,rx1),0)*greatest(least(y2,ry2)-greatest(y1,ry1),0) as s from {NEAREST} n left join {D} d on d.cam = n.clip and d.frame_idx = n.frame_idx),
k as (select *, case when rx1 is null then confidence else {PICK_IOU} end as score from j), b as (select *, row_number() over (partition by clip, blk, frame_idx order by score desc nulls last, det_rank) as r from k)
select clip, blk, frame_idx, behavior, name, track_id, x1, y1, x2, y2, slot is not null and (rx1 is null or score >= 0.1::double) as matched from b where r = 1)"""


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets = views.detections(spark, sf_dir).withColumnRenamed("cam", "clip")
    return labels.picked(referenced(spark, sf_dir), dets, 0.1)


@query(f"select clip, blk, frame_idx, matched, case when matched then x1 end as x1 from {PICKED}")
def f5_pick_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(spark, sf_dir).select("clip", "blk", "frame_idx", "matched", F.col("box.x1").alias("x1"))


SPLIT = "case when ('0x' || sha1('cam' || clip::varchar || '_x|' || '2024-02-' || lpad((clip % 28 + 1)::varchar, 2, '0'))[1:8])::bigint / 4294967295::double < 0.2::double then 'val' else 'train' end"


@query(f"""select 'behavior/' || split || '/' || behavior || '/' || clip::varchar || '_f' || lpad(frame_idx::varchar, 6, '0') || '_t' || coalesce(track_id, 'None') || '.jpg' as behavior_path, behavior, name, coalesce(track_id, '') as track_id, clip, split from (select *, {SPLIT} as split from {PICKED}) where matched""")
def a15_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.manifest(chosen(spark, sf_dir), views.clips(spark, sf_dir)).select("behavior_path", "behavior", "name", "track_id", "clip", "split")


@query(f"""select (select count(*) from {R}) as ranges, (select count(*) from {R} where behavior = 'excluded') as excluded, count(*) as sampled, count(case when matched then 1 end) as written, count(case when not matched then 1 end) as unmatched,
  count(case when matched and behavior = 'pee' then 1 end) as pee, count(case when matched and split = 'val' then 1 end) as val from (select *, {SPLIT} as split from {PICKED})""")
def g10_export_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.manifest(chosen(spark, sf_dir), views.clips(spark, sf_dir))
    stats = labels.export_stats(views.ranges(spark, sf_dir), samples(spark, sf_dir), rows)
    return stats.select("ranges", "excluded", "sampled", "written", "unmatched", F.coalesce(F.try_element_at("by_behavior", F.lit("pee")), F.lit(0)).alias("pee"), F.coalesce(F.try_element_at("by_split", F.lit("val")), F.lit(0)).alias("val"))
