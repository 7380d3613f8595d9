"""Pinning a result that must not be computed twice with different outcomes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def pinned(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder. Range partitionings sample their input, so a second run of
    the same plan may cut elsewhere. A cluster must name the folder in spark.checkpoint.dir; a local session gets one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
    return df.checkpoint()


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared checkpoint folder, for what is written once and read by later steps."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
    return f"{context.getCheckpointDir()}/{tag}-{uuid.uuid4().hex}"
