"""Intermediate tables that several stages read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir; only a local session that lacks it gets one of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or "/tmp/checkpoints")
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df by way of a table in the shared folder."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
