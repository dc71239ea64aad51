"""What several operators share: cut lineages, distributed ranks and connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of all word and normalisation rules here.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local folder on one machine
    (tests); on a cluster that is an error."""
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if known is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sightline-"))
        known = context.getCheckpointDir()
    return known.rstrip("/")


def cut(frame: DataFrame, sort_by: str | None = None, **options: str) -> DataFrame:
    """Writes a frame as Parquet to the shared folder and reads it again: later steps survive lost executors."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/sightline-{uuid.uuid4().hex}"
    if sort_by:
        frame = frame.sortWithinPartitions(sort_by)
    frame.write.options(**options).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def held(frame: DataFrame) -> DataFrame:
    """A frame computed once, as a checkpoint, which Spark removes when nothing refers to it any more (where
    spark.cleaner.referenceTracking.cleanCheckpoints is set): for copies of whole texts within one stage."""
    spark = frame.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return frame.checkpoint()


def release(spark: SparkSession) -> None:
    """After a cut: asks the driver for a garbage collection, by which Spark's cleaner finds the shuffles that no frame
    refers to any more and removes their files, rather than at the next chance (spark.cleaner.periodicGC.interval).
    Twice: the events of the query that has just ended still hold it for a moment."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def fine_buckets(rows: int, size: int = 4096) -> int:
    """A power of two: buckets of about so many rows each."""
    n = 1
    while n * size < rows:
        n *= 2
    return n


def heavy_join(left: DataFrame, right: DataFrame, key: str | list[str], weight: Column, total: int, parts: int = 200) -> DataFrame:
    """Inner join to a side with one row for each key. Keys of more than 1/parts of all left rows, which can be
    parts at most, are broadcast; the rest has no hot key and is shuffled."""
    keys = [key] if isinstance(key, str) else key
    heavy = weight > total / parts
    hot = F.broadcast(right.filter(heavy))
    return left.join(hot, keys).unionByName(left.join(hot.select(*keys), keys, "left_anti").join(right.filter(~heavy), keys))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b: long) as (node, component), the smallest id reachable; only linked nodes
    come back. Alternating large-star and small-star rounds, each of a few joins and partial aggregations; a centre of
    very many links is joined by broadcast, its links staying where they are. Every round's links are written to the
    shared folder. Ends when a round changes nothing."""
    star = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    digest = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    seen = digest(star)
    if not seen[0]:
        return star.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(rounds):
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = heavy_join(both, least, "a", F.col("n"), 2 * seen[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.unionByName(least.filter("m < a").select("a", F.col("m").alias("b"))).distinct())
        low = cut(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = heavy_join(large, low, "a", F.col("n"), seen[0]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = digest(star)
        if now == seen:
            ends = star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return star.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(ends)
        seen = now
    raise RuntimeError("components did not settle")


def ranked(frame: DataFrame, group: list[str], order: list[str], spread: Column, size: Column, rows: int) -> DataFrame:
    """Adds rank (from 0) and before (the sum of size over earlier rows) within each group, without ever bringing a
    group into one task: rows are dealt to buckets by spread (a long >= 0 below 2^31 by which rows are ordered first),
    ranked there, and shifted by the totals of earlier buckets. order breaks ties within a bucket."""
    n = fine_buckets(rows)
    shift = 31 - (n.bit_length() - 1)
    here = frame.withColumns({"spread_": spread, "size_": size}).withColumn("bucket_", F.shiftright("spread_", shift))
    within = Window.partitionBy(*group, "bucket_").orderBy("spread_", *order)
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*group).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    totals = here.groupBy(*group, "bucket_").agg(F.count("*").alias("n_"), F.sum("size_").alias("sum_"))
    totals = totals.select(*group, "bucket_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("n_"), F.coalesce(F.sum("sum_").over(earlier), F.lit(0)).alias("sum_"))
    for g in group:
        totals = totals.withColumnRenamed(g, f"{g}_t_")
    inner = here.withColumns({"rank": F.row_number().over(within) - 1, "before": F.sum("size_").over(so_far) - F.col("size_")})
    same = [inner[g].eqNullSafe(totals[f"{g}_t_"]) for g in group] + [inner["bucket_"] == totals["bucket_"]]
    joined = inner.join(totals, same).withColumns({"rank": (F.col("rank") + F.col("n_")).cast("long"), "before": (F.col("before") + F.col("sum_")).cast("long")})
    return joined.select(*frame.columns, "rank", "before")


def tile_groups(rows: DataFrame, key: str, item: Column, size: int, cell: Column | None = None, reach: int = 0) -> DataFrame:
    """Adds gid and side, so that rows of one gid can be compared in one task. A key of at most size rows is one gid
    (side 2: all of it). A larger one is cut into tiles within cells (ints; only cells at most reach apart are
    compared) and a row goes once to every pair of tiles that it is part of (sides 0 and 1, or 2 within one tile)."""
    rows = rows.withColumn("cell_", (F.lit(0) if cell is None else cell).cast("int"))
    cells = cut(rows.groupBy(key, "cell_").agg(F.count("*").alias("n_")))
    whole = Window.partitionBy(key)
    tiles = F.ceil(F.col("n_") / size).cast("int")
    info = cells.select(key, "cell_", "n_", tiles.alias("tiles_"), F.sum("n_").over(whole).alias("all_"), F.map_from_entries(F.collect_list(F.struct("cell_", tiles)).over(whole)).alias("map_")).filter("all_ > 1")
    alone, rest = info.filter(F.col("all_") <= size).select(key).distinct(), info.filter(F.col("all_") > size)
    total = cells.agg(F.coalesce(F.sum("n_"), F.lit(0))).first()[0]
    hot = rest.filter(F.col("all_") > total / 200).select(key).distinct()  # 200 at most: their rows need not be shuffled to be dropped
    small = rows.join(F.broadcast(hot), key, "left_anti").join(alone, key, "left_semi").select(*rows.columns, F.xxhash64(F.col(key)).alias("gid"), F.lit(2).alias("side"))
    large = heavy_join(rows, rest, [key, "cell_"], F.col("n_"), total).withColumn("tile_", F.pmod(F.xxhash64(item), F.col("tiles_")).cast("int"))
    mine = F.struct(F.col("cell_").alias("c"), F.col("tile_").alias("t"))
    others = F.flatten(F.transform(F.filter(F.sequence(F.col("cell_") - reach, F.col("cell_") + reach), lambda c: F.map_contains_key("map_", c)), lambda c: F.transform(F.sequence(F.lit(0), F.element_at("map_", c) - 1), lambda t: F.struct(c.alias("c"), t.alias("t")))))
    pair = lambda o: F.struct(F.xxhash64(F.col(key), F.least(mine, o)["c"], F.least(mine, o)["t"], F.greatest(mine, o)["c"], F.greatest(mine, o)["t"]).alias("gid"), F.when(mine == o, 2).when(mine < o, 0).otherwise(1).alias("side"))
    large = large.withColumn("to_", F.explode(F.transform(others, pair))).select(*rows.columns, "to_.gid", "to_.side")
    return small.unionByName(large).drop("cell_")


def in_groups(batches, gid: int = 0):
    """Of Arrow batches sorted by gid, tables that hold whole groups; a group that a batch cuts is carried over."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(gid).to_numpy()
        if held and held[-1].column(gid)[-1].as_py() != ids[0]:
            yield pa.Table.from_batches(held)
            held = []
        if ids[0] == ids[-1]:
            held.append(batch)
            continue
        last = len(ids) - int(np.argmax(ids[::-1] != ids[-1]))
        held.append(batch.slice(0, last))
        yield pa.Table.from_batches(held)
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def spare(name: str, columns: list[str]) -> str:
    """name, lengthened until no column is called so (in any case, as Spark compares)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, decide) -> DataFrame:
    """The rows of docs, with all their columns, whose row ids decide(docs with row ids, name of their column) returns as
    row_id."""
    row = spare("sightline_row", docs.columns)
    kept = held(docs.withColumn(row, F.monotonically_increasing_id()))
    stay = decide(kept, row).select(F.col("row_id").alias(row))
    return kept.join(stay, row, "left_semi").select(*docs.columns)
