"""Delayed release and the feed of new events, with state and timers.

An event waits until the watermark passes its end and post-roll, when a timer lets it go; events are dealt to buckets by
their keys, so that a batch costs a few calls of the state store for each bucket and not for each event. What still
waits when a run stops is read from the run's state and let go too, so that every event leaves once. A feed remembers
every id that it has seen, for ever, from the ids known at its start on.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.event_table import exists

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DUE, SHUTDOWN = "due", "shutdown"


def stateful(spark: SparkSession) -> None:
    """State with parts needs the store that has column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _Waiting(StatefulProcessor):
    """A bucket's events that are not due yet, and a timer for the first of them."""

    def __init__(self, fields: StructType):
        self.fields = fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.waiting = handle, handle.getListState("waiting", self.fields)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now, names = timerValues.getCurrentWatermarkInMs(), self.fields.fieldNames()
        due, later = [], []
        for row in rows:
            (due if row["due_ms"] <= now else later).append(tuple(row[f] for f in names))
        if later:
            self.waiting.appendList(later)
            self._wake(later)
        return self._out(due)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        due, later, at = [], [], self.fields.fieldNames().index("due_ms")
        for row in map(tuple, self.waiting.get()):
            (due if row[at] <= now else later).append(row)
        if due and later:
            self.waiting.put(later)
            self._wake(later)
        elif due:
            self.waiting.clear()
        return self._out(due)

    def _wake(self, rows: list[tuple]) -> None:
        at = self.fields.fieldNames().index("due_ms")
        self.handle.registerTimer(min(r[at] for r in rows))

    def _out(self, rows: list[tuple]) -> Iterator[Row]:
        names = self.fields.fieldNames()
        return (Row(**dict(zip(names, r, strict=True)), reason=DUE) for r in rows)

    def close(self) -> None:
        pass


def released(events: DataFrame, post_roll_s: float, key: str = "event_key", end: str = "end_ts", delay: str = "10 seconds", buckets: int | None = None) -> DataFrame:
    """The events of a stream, each when the watermark (the newest end seen, less delay) has reached its end and
    post-roll: all columns, due_ms (when it may leave, in milliseconds of time) and reason. An event without an end
    leaves at once. Events that come delay or more after later ones are dropped by the watermark, so delay has to cover
    what comes out of order. buckets (4 for each shuffle partition by default) is fixed for a checkpoint."""
    spark = events.sparkSession
    stateful(spark)
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = "bucket_"
    while bucket in (c.lower() for c in events.columns):
        bucket += "_"
    due = events.withColumn("due_ms", F.ceil((F.unix_micros(end) + F.lit(round(post_roll_s * 1e6))) / 1000).cast("long"))
    marked = due.filter(F.col(end).isNotNull()).withWatermark(end, delay).withColumn(bucket, F.pmod(F.xxhash64(key), F.lit(buckets)))
    out = StructType([*due.schema.fields, StructField("reason", StringType())])
    waited = marked.groupBy(bucket).transformWithState(_Waiting(due.schema), out, "append", "eventTime")
    return waited.unionByName(due.filter(F.col(end).isNull()).withColumn("reason", F.lit(DUE)))


def left_waiting(spark: SparkSession, checkpoint: str, schema: StructType) -> DataFrame:
    """What a run that has stopped held back, from its state: the rows that released would give, for reason shutdown."""
    state = spark.read.format("statestore").option("stateVarName", "waiting").option("operatorId", 0).load(checkpoint)
    return state.select("list_element.*").withColumn("reason", F.lit(SHUTDOWN)).select(*schema.fieldNames())


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Takes what is there now, and stops; a later call goes on where this one stopped."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def drained(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """A last run of a stream of released events, and all that it has ever let go, what waited at its end included. The
    checkpoint is done with then: a later run starts a new one."""
    run_to_end(stream, out, checkpoint)
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(out).unionByName(left_waiting(spark, checkpoint, stream.schema))


class _Seen(StatefulProcessor):
    """Whether an id has been seen, for ever."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first = next(iter(rows), None)
        if first is not None and not self.seen.exists():
            self.seen.update((1,))
            yield first

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self.seen.update((0,))

    def close(self) -> None:
        pass


def new_once(events: DataFrame, known: DataFrame | None = None, key: str = "event_id", kept: str | None = None) -> DataFrame:
    """The events of a stream whose ids were neither known at its first start nor seen since, restarts included. Of an
    id's rows in one batch, one. kept: a folder that belongs to the checkpoint as long as it lives; ids known at the
    first start are written there and looked up by a join, and ids are told apart without a call of Python for each.
    Without it, known ids become the state's first entries, id by id. A checkpoint goes on the way it was begun."""
    spark = events.sparkSession
    stateful(spark)
    if known is not None and kept is None:
        return events.groupBy(key).transformWithState(_Seen(), events.schema, "append", "none", known.select(key).distinct().groupBy(key))
    if known is not None:
        if not exists(spark, f"{kept}/_SUCCESS"):
            known.select(key).distinct().write.mode("overwrite").parquet(kept)
        ids = spark.read.schema(known.select(key).schema).parquet(kept).withColumnRenamed(key, "known_")
        events = events.join(ids, events[key].eqNullSafe(ids["known_"]), "left_anti")
    return events.dropDuplicates([key])
