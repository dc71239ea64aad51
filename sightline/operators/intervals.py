"""Intervals: joins on overlap, islands, merged ranges and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import settled

#: A level's buckets are this many times as wide as those of the level below; no interval is dealt to many more of them.
WIDER, LEVELS, FAR = 64, 8, 9e15


def _wide(level: Column, bucket: float) -> Column:
    return bucket * F.pow(F.lit(float(WIDER)), level)


def _bucket(time: Column, level: Column, bucket: float) -> Column:
    return F.floor(F.least(F.greatest(time, F.lit(-FAR)), F.lit(FAR)) / _wide(level, bucket)).cast("long")


def _levelled(rows: DataFrame, span: tuple[str, str], bucket: float) -> DataFrame:
    """rows whose start is not past their end, with level_: the finest whose buckets cut them in few pieces."""
    length = F.least(F.col(span[1]), F.lit(FAR)) - F.greatest(F.col(span[0]), F.lit(-FAR))
    level = F.lit(0)
    for n in range(LEVELS):
        level = level + (length > _wide(F.lit(n), bucket) * WIDER).cast("int")
    return rows.filter(F.col(span[0]) <= F.col(span[1])).withColumn("level_", level)


def _levels(rows: DataFrame) -> list[int]:
    """The levels that rows have: LEVELS + 1 at most."""
    return sorted(rows.agg(F.collect_set("level_")).first()[0])


def _array(levels: list[int]) -> Column:
    return F.array(*map(F.lit, levels)).cast("array<int>")


def _dealt(rows: DataFrame, span: tuple[str, str], others: Column, first: int, second: int, bucket: float) -> DataFrame:
    """rows in the buckets in which they can meet others, an array of the other side's levels. At its own level a row
    is a host: it meets hosts (role 0) and, if the other side has finer rows, guests (role first). At the other side's
    coarser levels it is a guest (role second)."""
    rows = rows.withColumn("others_", others)
    own, others = F.col("level_"), F.col("others_")
    place = lambda level, role: F.struct(level.alias("level_"), F.lit(role).alias("role_"))
    host = F.when(F.array_contains(others, own), F.array(place(own, 0))).otherwise(F.array().cast("array<struct<level_:int,role_:int>>"))
    meets = F.when(F.exists(others, lambda x: x < own), F.array(place(own, first))).otherwise(F.array().cast("array<struct<level_:int,role_:int>>"))
    guest = F.transform(F.filter(others, lambda x: x > own), lambda x: place(x, second))
    out = rows.withColumn("place_", F.explode(F.concat(host, meets, guest))).drop("level_", "others_").select("*", "place_.*").drop("place_")
    return _in_buckets(out, span, F.col("level_"), bucket)


def _in_buckets(rows: DataFrame, span: tuple[str, str], level: Column, bucket: float) -> DataFrame:
    return rows.withColumn("bucket_", F.explode(F.sequence(_bucket(F.col(span[0]), level, bucket), _bucket(F.col(span[1]), level, bucket))))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], bucket: float, longest: float | None = None) -> DataFrame:
    """Pairs of equal keys whose closed intervals touch. Columns of left and right must differ but for the keys; a and
    b name the start and end (doubles). Both sides are dealt to buckets of time, so only neighbours in time meet, and
    a pair is kept in the one bucket where the later of the two begins. Long intervals are dealt to wider buckets, so
    one with a wrong end (infinite, too) becomes few rows; short ones visit wide buckets only where the other side has
    long ones, and there meet these alone. Which levels there are is looked up first, so what comes from a long plan is
    best kept before (settled). longest: a length that no interval passes, where one is known; if it is short, nobody
    needs to look."""
    left, right = _levelled(left, a, bucket), _levelled(right, b, bucket)
    touch = (F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1]))
    short = longest is not None and longest <= WIDER * bucket
    of_left, of_right = ([0], [0]) if short else (_levels(left), _levels(right))
    if {*of_left, *of_right} <= {0}:  # all of them short
        level = F.lit(0)
        sides = (_in_buckets(d.drop("level_"), span, level, bucket) for d, span in ((left, a), (right, b)))
        pairs, more = next(sides).join(next(sides), [*keys, "bucket_"]), ["bucket_"]
    else:
        level, more = F.col("level_"), ["level_", "role_", "bucket_"]
        pairs = _dealt(left, a, _array(of_right), 1, 2, bucket).join(_dealt(right, b, _array(of_left), 2, 1, bucket), [*keys, *more])
    begins = _bucket(F.greatest(a[0], b[0]), level, bucket)
    return pairs.filter(touch & (F.col("bucket_") == begins)).drop(*more)


def islands(rows: DataFrame, keys: list[str], order: str, gap: float | Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows (from 0) that break where order grows by more than gap."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = (F.col(order) - F.lag(order).over(w) > gap).cast("int")
    return rows.withColumn("new_", F.coalesce(new, F.lit(0))).withColumn(name, F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new_")


def chains(rows: DataFrame, keys: list[str], start: str, end: str, slack: int = 0, name: str = "chain", ties: tuple[str, ...] = ()) -> DataFrame:
    """Numbers chains of intervals (from 0): one joins if it starts at most slack after all earlier ones ended."""
    w = Window.partitionBy(*keys).orderBy(start, *(t for t in (end, *ties)))
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col(start) > (reach + slack if slack else reach)).cast("int"), F.lit(0))
    return rows.withColumn("new_", new).withColumn(name, F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new_")


def merged_ranges(rows: DataFrame, keys: list[str], start: str = "start_frame", end: str = "end_frame") -> DataFrame:
    """Ranges that overlap or follow each other, fused."""
    found = chains(rows, keys, start, end, slack=1)
    return found.groupBy(*keys, "chain").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("chain")


#: Seconds of a key's history that one task cuts and numbers.
STRETCH_S = 86_400.0


def _opens(n_keys: int, tolerance_s: float):
    """For mapInArrow over rows sorted by keys and piece, then start: keys, piece, tie, start, end and whether a row
    opens a cluster. Only one cluster's anchor and reach are held."""

    def run(batches):
        import pyarrow as pa

        piece, anchor, reach = None, None, None
        for batch in batches:
            pieces = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys + 1)), strict=True))
            flags = []
            for here, s, e in zip(pieces, batch.column(n_keys + 2).to_pylist(), batch.column(n_keys + 3).to_pylist(), strict=True):
                joins = here == piece and s is not None and anchor is not None and (s <= reach or s - anchor <= tolerance_s)
                if joins:
                    reach = max(reach, e)
                else:
                    piece, anchor, reach = here, s, e
                flags.append(int(not joins))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], batch.column(n_keys + 1), batch.column(n_keys + 2), pa.array(flags, pa.int32())], names=[*batch.schema.names[:n_keys], batch.schema.names[n_keys + 1], "s_", "opens_"])

    return run


def anchored_clusters(rows: DataFrame, keys: list[str], start: str, end: str, tolerance_s: float, tie: str, stretch_s: float = STRETCH_S) -> DataFrame:
    """Numbers clusters (from 0) of start-sorted intervals: one joins if it starts before the cluster's reach, or at
    most tolerance_s after the cluster's first start, so a tolerance never chains. Starts and ends are doubles; a null
    start comes first and stays alone; a null end is the start. Keys are not null; tie tells a key's rows apart.

    Rows are first cut where a start is past every earlier end and more than tolerance_s past the start before it:
    no cluster crosses such a cut, so rows are folded, as a sorted stream, over short pieces and not over a key's whole
    history. Cutting and numbering go by stretches of time; of the stretches before, one row for each is needed."""
    part = [*keys, "stretch_"]
    order = Window.partitionBy(*part).orderBy(F.col("s_").asc_nulls_first(), tie)
    before, past = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("stretch_").rowsBetween(Window.unboundedPreceding, -1)
    stretch = F.coalesce(F.floor(F.col("s_") / stretch_s).cast("long"), F.lit(-(1 << 62)))

    def carried(d: DataFrame, known: dict[str, Column], over) -> DataFrame:
        each = d.groupBy(*part).agg(*(c.alias(n) for n, c in known.items()))
        return d.join(each.select(*part, *(over(n).over(earlier).alias(n) for n in known)), part)

    slim = rows.select(*keys, tie, F.col(start).alias("s_"), F.coalesce(F.col(end), F.col(start)).alias("e_")).withColumn("stretch_", stretch)
    slim = carried(slim, {"reach_": F.max("e_"), "last_": F.max("s_")}, F.max)
    reach, last = F.greatest(F.max("e_").over(before), "reach_"), F.greatest(F.max("s_").over(before), "last_")
    fresh = F.col("s_").isNull() | last.isNull() | ((F.col("s_") > reach) & (F.col("s_") - last > tolerance_s))
    slim = settled(slim.withColumn("new_", fresh.cast("int")).drop("reach_", "last_"))
    slim = carried(slim, {"pieces_": F.sum("new_")}, F.sum)
    slim = slim.withColumn("piece_", F.sum("new_").over(past) + F.coalesce("pieces_", F.lit(0))).select(*keys, "piece_", tie, "s_", "e_")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.select(*keys, tie, "s_").schema)
    opened = slim.repartition(*keys, "piece_").sortWithinPartitions(*keys, "piece_", F.col("s_").asc_nulls_first(), tie)
    opened = settled(opened.mapInArrow(_opens(len(keys), tolerance_s), f"{kinds}, opens_ int")).withColumn("stretch_", stretch)
    numbered = carried(opened, {"clusters_": F.sum("opens_")}, F.sum)
    number = (F.sum("opens_").over(past) + F.coalesce("clusters_", F.lit(0)) - 1).cast("int")
    return rows.join(numbered.select(*keys, tie, number.alias("cluster")), [*keys, tie])
