"""Tables in the shared folder: where a plan is cut, so that lost executors cost no rework and a part of it is run once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder, else one in the warehouse."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (own or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.lodeweave-checkpoints").rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table of its own in the shared folder and read it back. release() deletes it."""
    spark = df.sparkSession
    path = f"{folder(spark)}/lodeweave-{uuid.uuid4().hex}/{name}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete all tables that cut() has written, once their results are no longer needed; how many there were."""
    gone, fs = 0, spark.sparkContext._jvm.org.apache.hadoop.fs
    while _written:
        parent = fs.Path(_written.pop()).getParent()
        gone += bool(parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(parent, True))
    return gone
