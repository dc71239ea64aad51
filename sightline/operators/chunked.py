"""Folding a burst that never ends in parallel, and exactly.

A burst's frames are cut into chunks. Each is folded from a guessed state, that of a fold begun some frames earlier from
nothing, and says where it began and where it ended. A chunk whose beginning is not what the chunk before ended with is
folded again from there, until nothing differs; after ROUNDS of that, what still differs is folded to the burst's end in
one go, so that it always ends. Only chunks' states travel between them.

A fold has frame(number, rows) and end(), which give tuples, state() as plain data, resume(state), and follow(before,
carried, base, start, end): of a chunk that ran from start to end after one that ended as before (None at first), whether
it would have done the same from before; what its first numbers stand for; and before, carried and base for the next.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..lineage import settled
from .tracking import KEYS, in_order

#: Frames of a chunk; rounds of folding again in parallel.
CHUNK, ROUNDS = 1 << 16, 4
LINKS = "source string, segment long, chunk long, alike boolean, redo binary, carried array<long>, base long, total long"


class _Chunk:
    """A fold over one chunk: frames before it only prepare the state, which a first row may give instead."""

    def __init__(self, make: Callable, width: int):
        self.fold, self.width, self.start = make(), width, None

    def frame(self, number: int, rows: dict[str, np.ndarray]) -> list[tuple]:
        given = rows["start_"][0]
        if given is not None:
            self.fold.resume(pickle.loads(given))
            return []
        if rows["warm_"][0]:
            self.fold.frame(number, rows)
            return []
        self._begin()
        return [(*x, None, None) for x in self.fold.frame(number, rows)]

    def _begin(self) -> None:
        if self.start is None:
            self.start = self.fold.state()
            self.fold.resume(self.start)

    def end(self) -> list[tuple]:
        self._begin()
        return [(*[None] * self.width, pickle.dumps(self.start), pickle.dumps(self.fold.state()))]


def _folded(rows: DataFrame, columns: list[str], make: Callable, schema: StructType) -> DataFrame:
    """rows with chunk, warm_ and start_: the fold's tuples, and for each chunk a row with its states alone."""
    names = [*KEYS, "chunk", "frame_idx", "det_rank", *columns, "warm_", "start_"]
    own = [f for f in schema.fields if f.name not in KEYS]
    out = StructType([schema["source"], schema["segment"]]).add("chunk", "long")
    for f in own:
        out = out.add(f.name, f.dataType)
    out = out.add("begun_", "binary").add("ended_", "binary")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*names).repartition(parts, *KEYS, "chunk").sortWithinPartitions(*KEYS, "chunk", "frame_idx", "det_rank")
    return settled(dealt.mapInArrow(in_order(names, lambda: _Chunk(make, len(own)), out, 3), out))


def _linked(states: DataFrame, make: Callable) -> DataFrame:
    """For each chunk: whether it began as the one before ended, what its first numbers stand for, base before it and
    after."""

    def run(batches):
        import pyarrow as pa

        follow = make().follow
        burst, before, carried, base = None, None, [], 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = (row["source"], row["segment"])
                if key != burst:
                    burst, before, carried, base = key, None, [], 0
                was, begun = before, base
                alike, mine, before, carried, base = follow(before, carried, base, pickle.loads(row["begun_"]), pickle.loads(row["ended_"]))
                out.append((*key, row["chunk"], alike, None if alike else pickle.dumps(was), mine, begun, base))
            if out:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in LINKS.split(", ")])

    ordered = states.repartition(*KEYS).sortWithinPartitions(*KEYS, "chunk")
    return settled(ordered.mapInArrow(run, LINKS))


def _ends(states: DataFrame, make: Callable, schema: StructType) -> DataFrame:
    """What the folds say at their bursts' ends."""
    last = states.groupBy(*KEYS).agg(F.max_by("ended_", "chunk").alias("ended_"))

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                fold = make()
                fold.resume(pickle.loads(row["ended_"]))
                out += [(row["source"], row["segment"], *x) for x in fold.end()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    return last.mapInArrow(run, schema)


def by_chunk(rows: DataFrame, columns: list[str], make: Callable, schema: str, chunk: int = CHUNK, warm: int | None = None, ends: bool = True) -> tuple[DataFrame, DataFrame]:
    """Folds bursts as by_burst does (rows: source, segment, frame_idx, det_rank and columns), chunk by chunk. The tuples
    with chunk, those of the ends of bursts (if ends) in chunk null, and LINKS for each chunk. warm: how many
    frames before a chunk prepare its guess."""
    kind, warm = StructType.fromDDL(schema), max(1, chunk // 64) if warm is None else warm
    place = F.col("frame_idx") - F.floor(F.col("frame_idx") / chunk) * chunk
    number = F.floor(F.col("frame_idx") / chunk).cast("long")
    given = rows.select(*KEYS, "frame_idx", "det_rank", *columns)
    # The last frames of a chunk also prepare the next.
    to = F.array(F.struct(number.alias("chunk"), F.lit(False).alias("warm_")), F.struct((number + 1).alias("chunk"), F.lit(True).alias("warm_")))
    dealt = given.withColumn("to_", F.explode(F.slice(to, 1, F.when(place >= chunk - warm, 2).otherwise(1))))
    dealt = dealt.select(*given.columns, "to_.chunk", "to_.warm_", F.lit(None).cast("binary").alias("start_"))
    done = _folded(dealt, columns, make, kind)
    for turn in range(ROUNDS + 2):  # after the last, nothing differs
        states = done.filter(F.col("begun_").isNotNull()).select(*KEYS, "chunk", "begun_", "ended_")
        links = _linked(states, make)
        bad = links.filter(~F.col("alike")).select(*KEYS, "chunk", F.col("redo").alias("start_"))
        if bad.isEmpty():
            break
        plain = given.withColumn("chunk", number)
        if turn < ROUNDS:
            again = plain.join(bad.select(*KEYS, "chunk"), [*KEYS, "chunk"], "left_semi")
            left = done.join(bad.select(*KEYS, "chunk"), [*KEYS, "chunk"], "left_anti")
        else:  # from the first that differs on, all of the burst
            bad = bad.withColumn("n_", F.row_number().over(Window.partitionBy(*KEYS).orderBy("chunk"))).filter("n_ = 1").drop("n_")
            first = bad.select(*KEYS, F.col("chunk").alias("first_"))
            again = plain.join(first, KEYS).filter("chunk >= first_").drop("chunk").withColumnRenamed("first_", "chunk")
            left = done.join(first, KEYS, "left").filter("first_ is null or chunk < first_").drop("first_")
        again = again.select(*given.columns, "chunk", F.lit(False).alias("warm_"), F.lit(None).cast("binary").alias("start_"))
        begin = bad.select(*KEYS, "chunk", "start_", F.lit(-(1 << 62)).alias("frame_idx"), F.lit(False).alias("warm_"))
        done = settled(left.unionByName(_folded(again.unionByName(begin, allowMissingColumns=True), columns, make, kind)))
    out = done.filter(F.col("begun_").isNull()).drop("begun_", "ended_")
    return out.unionByName(_ends(states, make, kind), allowMissingColumns=True) if ends else out, links
