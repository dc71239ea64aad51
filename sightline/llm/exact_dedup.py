"""Exact deduplication by a log-structured merge index of digests, with DataFrame operations only.

Each input partition is a memtable: its (digest, length, id) entries are sorted by digest and flushed as one Parquet
run with a Bloom filter on the digest. Compaction merges all runs to one sorted run that keeps, for each digest, the
entry that stays and the number of rows. Rows that hit a digest held by others are verified byte by byte against the
text that stays.

Defined cases: a null text is empty, and empty texts are equal to each other; of equal texts the longest original
(code points) stays, then the smallest doc_id, a null doc_id last, then either of rows that repeat; very long texts
are hashed and compared whole; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, cut, heavy_join, keep_rows

#: Rows of one group that meet the text that stays in one task.
SALT_ROWS = 2000
FILTER = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled#digest": "true"}


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def digest(norm: Column) -> Column:
    return F.unhex(F.sha2(F.encode(norm, "UTF-8"), 256))


def _entries(docs: DataFrame, id_col: str, text_col: str, row: Column | None = None) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.monotonically_increasing_id() if row is None else row
    return docs.select(row.alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.length(text).alias("points"), normalised(F.col(text_col)).alias("norm")).withColumn("digest", digest(F.col("norm")))


def flush_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One sorted, filtered run for each memtable: row_id, doc_id, points, digest."""
    entries = _entries(docs, id_col, text_col, row_col and F.col(row_col)).select("row_id", "doc_id", "points", "digest")
    return cut(entries, sort_by="digest", **FILTER)


def compact(runs: DataFrame) -> DataFrame:
    """Merges runs: digest, keep (the entry that stays), group_size. Runs of several batches can be united before."""
    rank = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("row_id").alias("r"))
    merged = runs.groupBy("digest").agg(F.min(rank).alias("keep"), F.count("*").alias("group_size"))
    return cut(merged, sort_by="digest", **FILTER)


def unequal(docs: DataFrame, index: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verifies hits: the digests that stand for different bytes. Texts meet the index once (a join that Spark may
    split); those of groups are then salted, so that a large group's rows meet its kept text in many tasks."""
    several = index.filter("group_size > 1").select("digest", (1 + F.floor(F.col("group_size") / SALT_ROWS)).alias("salts"), F.col("keep.i").alias("keep_id"), (-F.col("keep.p")).alias("keep_points"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))
    salt = F.pmod(F.monotonically_increasing_id(), F.col("salts"))
    hits = cut(_entries(docs, id_col, text_col).join(several, "digest").select("digest", "norm", stays.alias("stays"), "salts", salt.alias("salt")))
    keepers = hits.filter("stays").dropDuplicates(["digest"]).select("digest", F.col("norm").alias("kept_norm"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    return hits.select("digest", "salt", "norm").join(keepers, ["digest", "salt"]).filter("norm <> kept_norm").select("digest").distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, row_id (row_col, if given)."""
    runs = flush_runs(docs, id_col, text_col, row_col)
    index = compact(runs)
    total = runs.count()
    wrong = cut(unequal(docs, index, id_col, text_col))
    found = heavy_join(runs, index, "digest", F.col("group_size"), total)
    result = found.select("doc_id", F.col("keep.i").alias("keep_id"), "group_size", (F.col("row_id") == F.col("keep.r")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "row_id")
    if wrong.isEmpty():
        return result
    # Different bytes under one digest: those few digests are grouped by the bytes themselves.
    again = _entries(docs, id_col, text_col, row_col and F.col(row_col)).join(wrong, "digest")
    again = cut(again)
    rank = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("row_id").alias("r"))
    groups = again.groupBy("digest", "norm").agg(F.min(rank).alias("keep"), F.count("*").alias("group_size"))
    split = again.join(groups, ["digest", "norm"]).select("doc_id", F.col("keep.i").alias("keep_id"), "group_size", (F.col("row_id") == F.col("keep.r")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "row_id")
    return result.join(wrong.select(F.lower(F.hex("digest")).alias("text_sha256")), "text_sha256", "left_anti").select(*split.columns).unionByName(split)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat wholly, one."""
    return keep_rows(docs, lambda d, row: exact_dedup(d, id_col, text_col, row).filter("kept"))
