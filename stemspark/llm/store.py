"""Where jobs put what they write between their steps: the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from py4j.protocol import Py4JError, Py4JNetworkError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, one under the temp folder, on a single machine only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all of them reach")
    return f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses. It is this process's own and goes with release(), at its end."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _OWN[path] = spark
    return path


#: Paths that this process has taken and that are still there.
_OWN: dict[str, SparkSession] = {}


def release() -> None:
    """Delete what this process has written to paths of its own. Results that were not collected or written by then, and files
    written without a path of the caller's, are gone."""
    for path, spark in list(_OWN.items()):
        try:
            drop(spark, path)
        except (Py4JError, Py4JNetworkError, AttributeError, OSError):  # the session has been stopped already
            _OWN.pop(path, None)


atexit.register(release)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: later steps don't repeat it, lost executors don't undo it.

    It stays until release(), as a result that is still to be read needs it; what only the steps before need goes to a
    Scratch."""
    return _written(df, fresh(df.sparkSession, name))


class Scratch:
    """Tables of one job in a folder of their own, which go together once nothing reads them any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self._n = spark, fresh(spark, name), 0

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        return _written(df, f"{self.folder}/{self._n:04d}-{name}")

    def drop(self) -> None:
        drop(self.spark, self.folder)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder once nothing reads it any more; it's no error if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _OWN.pop(path, None)


def parts(spark: SparkSession) -> int:
    """How many partitions a shuffle has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_id(df: DataFrame, name: str = "doc_id") -> Column:
    """An id column as a 64-bit integer; ids of another kind are refused, not made null."""
    kind = df.schema[name].dataType
    if not isinstance(kind, IntegralType | NullType):
        raise TypeError(f"{name} must be an integer column, not {kind.simpleString()}")
    return df[name].cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name
