"""Cutting a plan's lineage so that it survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import NullType


def shared_folder(spark: SparkSession) -> str:
    """Where tables that executors and driver share may be written: the checkpoint folder. Where it is unset, a local
    folder on one machine; on a cluster that is an error."""
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if known is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sightline-"))
        known = context.getCheckpointDir()
    return known.rstrip("/")


def settled(frame: DataFrame) -> DataFrame:
    """frame, computed once and kept in the checkpoint folder."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint()


def stored(frame: DataFrame) -> DataFrame:
    """frame, computed once and kept as a table in the checkpoint folder, in columns and compressed: for large frames
    whose order and partitions nobody relies on."""
    if any(isinstance(f.dataType, NullType) for f in frame.schema):
        return settled(frame)
    path = f"{shared_folder(frame.sparkSession)}/stored-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
