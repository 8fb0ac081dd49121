"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a temporary one on local masters, and an error on clusters."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    return _own(spark.sparkContext.applicationId)


@functools.cache
def _own(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-meander-")


def _of(spark: SparkSession) -> str:
    return f"{folder(spark)}/meander/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_of(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; for when all results that read them have been written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_of(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
