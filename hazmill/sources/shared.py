"""The folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the folder that the session names in spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of its own beside the session's checkpoints, for what lives as long as they do."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
