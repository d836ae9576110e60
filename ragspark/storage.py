"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir.

    Only a local master may do without: a temporary folder is made then. On a cluster each executor would write
    to its own disk, so a session that names no folder is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def scratch(spark: SparkSession) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/ragspark-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of df from Parquet in the shared folder: computed once, and safe from lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
