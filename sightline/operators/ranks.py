"""Places in one order of all rows, without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import settled


def placed(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with place, from 1, by order (which should tell all rows apart): rows are dealt to ranges of the order,
    numbered within each, and shifted by the counts of earlier ranges, one number for each range."""
    parts = settled(rows.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))
    earlier = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("part_").agg(F.count("*").alias("n_")).select("part_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("before_"))
    here = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    return parts.withColumn("here_", here).join(F.broadcast(counts), "part_").select(*rows.columns, (F.col("here_") + F.col("before_")).alias("place"))
