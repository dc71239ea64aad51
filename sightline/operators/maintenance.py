"""Upkeep of the event table: states, quarantine, retention, label updates. Every removal is planned as rows first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..lineage import settled


def source_exists(events: DataFrame, recordings: DataFrame, fields: tuple[str, ...] = ("source_path", "source_id", "sanitized_source_id")) -> DataFrame:
    """events with source_exists: any field names a recording's path, also as a file: URL. recordings: path."""
    plain = lambda v: F.regexp_replace(F.regexp_replace(v, r"^file:(//)?", ""), "%20", " ")
    named = F.filter(F.array_distinct(F.flatten(F.array(*(F.array(F.col(f), plain(F.col(f))) for f in fields)))), lambda v: F.coalesce(v != "", F.lit(False)))
    found = events.select("event_key", F.explode(named).alias("path")).join(recordings.select("path").distinct(), "path", "left_semi").select("event_key").distinct()
    return events.join(found.withColumn("source_exists", F.lit(True)), "event_key", "left").withColumn("source_exists", F.coalesce("source_exists", F.lit(False)))


def states(events: DataFrame, recordings: DataFrame) -> DataFrame:
    """events with state: labeled, deterministic, source_missing or removable."""
    human = keys.human_signal(*(F.col(c) for c in ("label_status", "label", "name", "label_note", "labeled_at")))
    return source_exists(events, recordings).withColumn("state", keys.event_state(human, F.col("end_s"), F.col("recorded_s"), F.col("source_exists")))


def quarantined(classified: DataFrame, stamp: str) -> tuple[DataFrame, DataFrame]:
    """(events that stay, events for the trash with their stamp). Nothing that a human touched may go."""
    gone = settled(classified.filter("state = 'removable'").withColumn("trashed_at", F.lit(stamp)))
    human = keys.human_signal(*(F.col(c) for c in ("label_status", "label", "name", "label_note", "labeled_at")))
    if not gone.filter(human).isEmpty():
        raise RuntimeError("a labelled event would be removed")
    stay = classified.join(gone.select("event_key"), "event_key", "left_anti")
    return stay, gone


def retention_plan(events: DataFrame, cameras: DataFrame, now_s: float) -> DataFrame:
    """events (camera_id, event_key, modified_s, bytes) with reason: `age` past the camera's days, `size` for the oldest
    of the rest until at most its cap is left, else null. cameras: retention_days, max_bytes (null: no cap)."""
    rows = events.join(cameras.select("camera_id", "retention_days", "max_bytes"), "camera_id")
    old = F.col("modified_s") < now_s - F.col("retention_days") * 86400.0
    rows = rows.withColumn("old_", F.coalesce(old, F.lit(False)))
    # Sums over a camera's history go by days: of all days before, one row each is needed.
    day = F.coalesce(F.floor(F.col("modified_s") / 86400.0).cast("long"), F.lit(-(1 << 62)))
    rows = rows.withColumns({"day_": day, "left_": F.when(~F.col("old_"), F.col("bytes")).otherwise(0)})
    camera = Window.partitionBy("camera_id")
    days = rows.groupBy("camera_id", "day_").agg(F.sum("left_").alias("n_"))
    earlier = F.sum("n_").over(camera.orderBy("day_").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select("camera_id", "day_", F.coalesce(earlier, F.lit(0)).alias("earlier_"), F.sum("n_").over(camera).alias("total_"))
    oldest = Window.partitionBy("camera_id", "day_").orderBy("modified_s", "event_key")
    before = F.coalesce(F.sum("left_").over(oldest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("earlier_")
    rows, total = rows.join(days, ["camera_id", "day_"]), F.col("total_")
    over = F.col("max_bytes").isNotNull() & (total - before > F.col("max_bytes"))
    return rows.withColumn("reason", F.when(F.col("old_"), "age").when(over, "size")).select(*events.columns, "reason")


def retained(events: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events that stay, one row for each camera: deleted, deleted_bytes, remaining_bytes)."""
    gone = F.col("reason").isNotNull()
    summary = plan.groupBy("camera_id").agg(F.count_if(gone).alias("deleted"), F.sum(F.when(gone, F.col("bytes")).otherwise(0)).alias("deleted_bytes"), F.sum(F.when(~gone, F.col("bytes")).otherwise(0)).alias("remaining_bytes"))
    return events.join(plan.filter("reason is not null").select("event_key"), "event_key", "left_anti"), summary


def label_updates(updates: DataFrame, roster: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good, bad) updates: event_key, label, label_status, has_name, name, label_note, labeled_at. Bad ones get a
    reason: unknown label or status, or a name that the roster, where there is one, doesn't hold."""
    name = F.nullif(F.trim("name"), F.lit(""))
    known = name.isNull() | ~F.col("has_name") | F.lit(not roster) | name.isin(roster or [""])
    fine_label, fine_status = (F.coalesce(F.col(c).isin(*values), F.lit(False)) for c, values in (("label", keys.LABELS), ("label_status", keys.STATUSES)))
    reason = F.when(~fine_label, "label").when(~fine_status, "status").when(~known, "name")
    marked = updates.withColumns({"name": name, "reason": reason})
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def updated(events: DataFrame, good: DataFrame) -> DataFrame:
    """events with each one's updates applied: the latest label and status; the latest name and note that were given."""
    order = F.struct("labeled_at", "label", "label_status")
    last = good.groupBy("event_key").agg(
        F.max_by(F.struct("label", "label_status", "labeled_at"), order).alias("u_"),
        F.max_by(F.struct("name"), F.when(F.col("has_name"), order)).alias("n_"), F.max_by("label_note", F.when(F.col("label_note").isNotNull(), order)).alias("note_"),
    )
    rows = events.join(last, "event_key", "left")
    hit = F.col("u_").isNotNull()
    return rows.withColumns({
        **{f: F.when(hit, F.col(f"u_.{f}")).otherwise(F.col(f)) for f in ("label", "label_status", "labeled_at")},
        "name": F.when(F.col("n_").isNotNull(), F.col("n_.name")).otherwise(F.col("name")), "label_note": F.coalesce("note_", "label_note"),
    }).select(*events.columns)
