"""What the operators of this subpackage share: the shared folder, cut points and word rules."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words, as a Java character class body and as a plain string.
SPACE_CLASS = " \\t-\\r"
SPACE_CHARS = " \t\n\x0b\x0c\r"

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder, else one in the warehouse, never a
    machine's own temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        spark.sparkContext.setCheckpointDir(f"{warehouse}/.lodeweave-checkpoints")
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, removed when the driver ends."""
    path = f"{shared_folder(spark)}/lodeweave-{uuid.uuid4().hex}/{name}"
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that new_folder() named."""
    jvm = spark.sparkContext._jvm
    parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
    parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(parent, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends and lost executors cost no rework."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                remove(spark, path)
        except Exception:  # the JVM may be gone
            return


def text_of(col: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once: within a lambda the optimizer cannot paste it into each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Array of the maximal runs without white space; empty array for a text without words."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE_CLASS}]+"))


def count_words(text: Column) -> Column:
    """Number of maximal runs without white space."""
    return F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")).cast("long")
