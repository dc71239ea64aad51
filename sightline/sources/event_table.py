"""The event table on disk, by camera and day, changed in place.

A change rewrites the partitions that it touches and no others: their new rows are computed first and kept, then replace
the old ones, and are read back and compared. What is removed can go to a trash, a table by the time of the removal,
from which it can be restored; it is there before the table loses it. A change that is tried again after it broke off
ends up the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..lineage import settled, stored
from ..operators import reconcile

PARTS = ["camera_dir", "date_dir"]


@dataclass
class Change:
    """How many partitions were touched, and rows removed, written and left in them."""

    partitions: int
    removed: int
    written: int
    left: int


def create(events: DataFrame, path: str) -> None:
    """Writes events (event_key, camera_dir, date_dir, ...) as a table, one file for each day of a camera."""
    events.repartition(*PARTS).write.mode("overwrite").partitionBy(*PARTS).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as it is now."""
    plain = spark.read.option("basePath", path).option("inferSchema", False).parquet(path)
    return plain.withColumns({p: F.col(p).cast("string") for p in PARTS})


def human(rows: DataFrame) -> DataFrame:
    """Rows that a human has touched."""
    return rows.filter(keys.human_signal(*(F.col(c) for c in ("label_status", "label", "name", "label_note", "labeled_at"))))


def change(spark: SparkSession, path: str, removed: DataFrame | None = None, written: DataFrame | None = None, trash: str | None = None, stamp: str = "") -> Change:
    """Removes rows by event_key, then writes whole rows, which replace those of the same key. With a trash, removed rows
    go there first, under stamp."""
    table = read(spark, path)
    gone = table.limit(0).select("event_key") if removed is None else removed.select("event_key").distinct()
    gone = stored(gone)
    fresh = stored(table.limit(0) if written is None else written.select(*table.columns))
    leaving = stored(table.join(gone, "event_key", "left_semi"))
    replaced = table.join(fresh.select("event_key"), "event_key", "left_semi")
    touched = stored(leaving.select(*PARTS).unionByName(fresh.select(*PARTS)).unionByName(replaced.select(*PARTS)).distinct())
    out = gone.unionByName(fresh.select("event_key")).distinct()
    rows = table.join(touched, PARTS, "left_semi").join(out, "event_key", "left_anti").select(*table.columns).unionByName(fresh)
    rows = stored(rows)
    if trash is not None:
        bin_ = f"{trash}/trashed_at={stamp}"
        leaving.repartition(*PARTS).write.mode("overwrite").partitionBy(*PARTS).parquet(bin_)
        _same(leaving, _read_or(spark, bin_, leaving), "the trash")
    rows.repartition(*PARTS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(path)
    for row in touched.join(rows.select(*PARTS).distinct(), PARTS, "left_anti").toLocalIterator():  # partitions left empty
        _delete(spark, "/".join([path, *(f"{p}={_escaped(spark, row[p])}" for p in PARTS)]))
    _same(rows, _read_or(spark, path, rows).join(touched, PARTS, "left_semi"), "the table")
    return Change(touched.count(), leaving.count(), fresh.count(), rows.count())


def _read_or(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at path with the columns of like; none where nothing is left."""
    columns = [f for f in like.schema.fields if f.name not in PARTS] + [f for f in like.schema.fields if f.name in PARTS]
    schema = type(like.schema)(columns)
    return spark.read.schema(schema).option("basePath", path).parquet(path).select(*like.columns)


def _same(wanted: DataFrame, found: DataFrame, where: str) -> None:
    """Both hold the same rows, as far as their count and the sum of their hashes tell."""
    digest = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64(*wanted.columns).cast("decimal(38,0)"))).first())
    if digest(wanted) != digest(found):
        raise RuntimeError(f"{where} does not hold what was written")


def _escaped(spark: SparkSession, value: str | None) -> str:
    """A partition's value as it stands in a path."""
    catalog = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return "__HIVE_DEFAULT_PARTITION__" if value is None or value == "" else catalog.escapePathName(value)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def restore(spark: SparkSession, path: str, trash: str, stamp: str) -> Change:
    """Puts back what went to the trash at stamp; it stays in the trash too."""
    back = spark.read.option("basePath", f"{trash}/trashed_at={stamp}").parquet(f"{trash}/trashed_at={stamp}")
    return change(spark, path, written=back.withColumns({p: F.col(p).cast("string") for p in PARTS}))


# ---- changes that plans ask for ----------------------------------------------------------------------------------


def collapse(spark: SparkSession, path: str, tolerance_s: float, trash: str, stamp: str) -> tuple[Change, Change]:
    """Clusters of reruns become one event each: labels first, removals after, so that none is lost in between."""
    table = read(spark, path)
    gone, relabelled = reconcile.collapse_changes(table, settled(reconcile.collapse_plan(table, tolerance_s)))
    gone, marks = settled(gone), settled(_labels(table))
    first = change(spark, path, written=relabelled)
    second = change(spark, path, removed=gone, trash=trash, stamp=stamp)
    if not marks.exceptAll(_labels(read(spark, path))).isEmpty():
        raise RuntimeError("a label was lost")
    return first, second


def _labels(rows: DataFrame) -> DataFrame:
    return rows.filter(reconcile.is_labeled(F.col("label_status"))).select("camera_id", "source_id", "label", "name", "label_note").distinct()


def quarantine(spark: SparkSession, path: str, classified: DataFrame, trash: str, stamp: str) -> Change:
    """Moves removable events (classified: event_key, state) to the trash; nothing that a human touched may go."""
    gone = settled(classified.filter("state = 'removable'").select("event_key"))
    touched = human(read(spark, path))
    if not touched.join(gone, "event_key", "left_semi").isEmpty():
        raise RuntimeError("a labelled event would be removed")
    before = settled(touched.select("event_key"))
    done = change(spark, path, removed=gone, trash=trash, stamp=stamp)
    if not before.join(read(spark, path), "event_key", "left_anti").isEmpty():
        raise RuntimeError("a labelled event was removed")
    return done


def retain(spark: SparkSession, path: str, plan: DataFrame) -> Change:
    """Deletes the events that a retention plan (event_key, reason) gives a reason for."""
    return change(spark, path, removed=plan.filter("reason is not null"))


def record(spark: SparkSession, path: str, new: DataFrame, tolerance_s: float) -> Change:
    """Settles a run's new events (whole rows and seq) against the table: see reconcile.recorded. What the run changes is
    written down first (in path-runs, by what the run holds), so a run that broke off goes on as it was meant, and one
    that was applied is not applied again."""
    new = stored(new)
    n, total = new.agg(F.count("*"), F.sum(F.xxhash64(*new.columns).cast("decimal(38,0)"))).first()
    intent = f"{path}-runs/{n}-{total or 0}"
    if exists(spark, f"{intent}/done"):
        return Change(0, 0, 0, 0)
    if not exists(spark, f"{intent}/fresh/_SUCCESS"):
        superseded, fresh = reconcile.run_changes(new, read(spark, path), tolerance_s)
        superseded.write.mode("overwrite").parquet(f"{intent}/superseded")
        fresh.write.mode("overwrite").parquet(f"{intent}/fresh")
    table = read(spark, path)
    fresh = spark.read.schema(table.schema).parquet(f"{intent}/fresh")
    written = change(spark, path, written=fresh)
    gone = spark.read.schema(table.select("event_key").schema).parquet(f"{intent}/superseded")
    removed = change(spark, path, removed=gone)
    spark.range(1).write.mode("overwrite").parquet(f"{intent}/done")
    return Change(written.partitions + removed.partitions, removed.removed, written.written, removed.left)


def record_sink(path: str, tolerance_s: float):
    """For foreachBatch: each batch of new events is a run."""

    def write(batch: DataFrame, number: int) -> None:
        record(batch.sparkSession, path, batch, tolerance_s)

    return write
