"""Folders that the driver and all executors share, for what a job writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's place below spark.checkpoint.dir; where that is unset, below one of our own if all tasks run in this process, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master) is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = spark.sparkContext.getCheckpointDir()
    base = re.sub(r"^file:/(?!/)", "file:///", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and checkpointed in the shared folder."""
    shared_folder(df.sparkSession, "checkpoint")  # makes sure that there is one
    return df.checkpoint()
