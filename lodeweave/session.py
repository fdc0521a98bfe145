"""Sessions with the settings that this library is meant to run under."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings for large inputs; a cluster's own settings come first where they are given.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def build(master: str | None = None, app: str = "lodeweave", **conf: str) -> SparkSession:
    """A session with DEFAULTS under conf."""
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS | conf)
    if master:
        builder = builder.master(master)
    return ship_code(builder.getOrCreate())


def ship_code(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, whatever their working folder is."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark
