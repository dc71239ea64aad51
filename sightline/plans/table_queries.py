"""Queries over the event table as it stands after a change was applied to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maintenance
from ..sources import event_table
from . import event_queries, views
from .registry import SQL, query
from .track_queries import folder

STAMP = "20240101T000000Z"


def placed(rows: DataFrame) -> DataFrame:
    """events with the partitions of their table."""
    return rows.withColumns({"camera_dir": F.concat(F.lit("Cam"), "camera_id"), "date_dir": F.date_format(F.timestamp_seconds("start_s"), "yyyy-MM-dd")})


def event_table_of(spark: SparkSession, sf_dir: str) -> str:
    path = folder(spark, "event_table")
    event_table.create(placed(views.events(spark, sf_dir)), path)
    return path


@query(SQL["m1_collapsed_events"])
def m1_applied_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = event_table_of(spark, sf_dir)
    event_table.collapse(spark, path, 60.0, f"{path}-trash", STAMP)
    return event_table.read(spark, path).select("event_key", "label", "label_status")


@query(f"select event_key, case when state = 'removable' then '{STAMP}' end as trashed_at from {event_queries.STATES}")
def m2_applied_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays in the table, and what lies in the trash."""
    path = event_table_of(spark, sf_dir)
    trash = f"{path}-trash"
    event_table.quarantine(spark, path, event_queries.classified(spark, sf_dir), trash, STAMP)
    stay = event_table.read(spark, path).select("event_key", F.lit(None).cast("string").alias("trashed_at"))
    return stay.unionByName(spark.read.parquet(trash).select("event_key", F.col("trashed_at").cast("string").alias("trashed_at")))


@query(f"select event_key from {event_queries.STATES}")
def m2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after a quarantine that was taken back."""
    path = event_table_of(spark, sf_dir)
    event_table.quarantine(spark, path, event_queries.classified(spark, sf_dir), f"{path}-trash", STAMP)
    event_table.restore(spark, path, f"{path}-trash", STAMP)
    return event_table.read(spark, path).select("event_key")


@query(f"select event_key, camera_id, bytes from {event_queries.RETENTION} where reason is null")
def m4_applied_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = event_table_of(spark, sf_dir)
    rows = event_table.read(spark, path)
    now = rows.agg(F.max("modified_s")).first()[0]
    event_table.retain(spark, path, maintenance.retention_plan(rows, event_queries.cameras(spark, sf_dir), now))
    return event_table.read(spark, path).select("event_key", "camera_id", "bytes")


@query(SQL["k7_recorded_run"])
def k7_applied_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New events arrive as a stream, whose sink settles them against the table; a batch that comes again changes
    nothing."""
    path, feed = event_table_of(spark, sf_dir), folder(spark, "feed")
    new = placed(views.new_events(spark, sf_dir))
    new.coalesce(1).write.parquet(feed)
    sink = event_table.record_sink(path, 5.0)
    for state in ("a", "b"):  # the second run starts from nothing: the same batch again
        stream = spark.readStream.schema(new.schema).parquet(feed)
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}-state-{state}").trigger(availableNow=True).start().awaitTermination()
    return event_table.read(spark, path).select("event_key", "event_id", "label", "label_status")
