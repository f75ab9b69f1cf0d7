"""Paths for tables between steps: in the folder of spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh(spark: SparkSession, name: str) -> str:
    """A new path; where spark.checkpoint.dir is unset, under the temp folder, on a single machine only."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all of them reach")
    root = root or f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
