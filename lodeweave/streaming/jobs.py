"""Structured Streaming: incremental upkeep of the catalogue from files and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeweave.operators import ordinals
from lodeweave.shared import cut

# Fixed values: (event, states it applies to, state after it); last lines that end a job's log.
TRANSITIONS = (
    ("start", ("pending", "failed"), "running"), ("resume", ("paused", "failed"), "running"), ("pause", ("running",), "paused"),
    ("cancel", ("pending", "running", "paused"), "cancelled"), ("complete", ("running",), "completed"), ("fail", ("running", "paused"), "failed"),
)
END_LINES = ("completed", "failed", "cancelled")


def events(spark: SparkSession, folder: str, schema, pattern: str = "events.parquet", per_trigger: int = 100) -> DataFrame:
    """A stream of the event files of a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def windowed(stream: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, key, n, total per window; rows later than `late` behind the newest are dropped once their window is out."""
    w = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("w.start").alias("start"), key, "n", "total")


def first_seen(stream: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key's first row, with state bounded by the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def last_status(stream: DataFrame, job: str, time: str, status: str) -> DataFrame:
    """Newest status per job, for output mode update or complete."""
    return stream.groupBy(job).agg(F.max_by(status, time).alias("status"), F.max(time).alias("since"))


def upsert_into(spark: SparkSession, path: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that rewrites a table as merge(stored, batch), version by version: a batch that is replayed
    writes its version anew, so results are exactly once."""

    def sink(batch: DataFrame, epoch: int) -> None:
        stored = spark.read.parquet(f"{path}/v{epoch - 1}") if epoch else None
        merge(stored, batch).write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return sink


def run_once(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Work off all that is there and give the result, which a table below `path` (a shared folder) holds: each trigger
    writes its own rows, in complete mode the last trigger's stand for all. Nothing passes the driver."""
    spark, schema = stream.sparkSession, stream.schema

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/epoch={0 if mode == 'complete' else epoch}")

    query: StreamingQuery = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/rows")


def statuses(events: DataFrame, job: str, time: str, event: str) -> DataFrame:
    """The state machine of jobs over their events in order of time: start and resume run a pending, paused or failed job,
    pause stops a running one, cancel, complete and fail end one that runs or is paused; other events change nothing.
    Events of a job are folded in order in one array, as a job has few. -> job, status, n_changes."""
    steps = events.groupBy(job).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), F.col(event).alias("e")))), lambda x: x["e"]).alias("steps"))

    def after(s: Column, e: Column) -> Column:
        out = s
        for name, froms, to in TRANSITIONS:
            out = F.when((e == name) & s.isin(*froms), to).otherwise(out)
        return out

    def fold(a: Column, e: Column) -> Column:
        new = after(a["s"], e)
        return F.struct(new.alias("s"), (a["n"] + F.when(new != a["s"], 1).otherwise(0)).alias("n"))

    done = F.aggregate("steps", F.struct(F.lit("pending").alias("s"), F.lit(0).alias("n")), fold)
    return steps.select(job, done.alias("x")).select(job, F.col("x.s").alias("status"), F.col("x.n").alias("n_changes"))


def log_feed(lines: DataFrame, job: str, time: str, text: str, most: int = 2000) -> DataFrame:
    """What a reader who joins late is sent: each job's newest lines in order (`seq` from 1), then DONE where its last line ends it."""
    kept = cut(log_history(lines, job, time, most), "newest_lines")
    seq = F.row_number().over(Window.partitionBy(job).orderBy(time))
    feed = kept.select(job, seq.cast("long").alias("seq"), F.col(text).alias("line"))
    ends = kept.groupBy(job).agg(F.max_by(text, time).alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("last").isin(*END_LINES))
    return feed.unionByName(ends.select(job, (F.col("n") + 1).alias("seq"), F.lit("DONE").alias("line")))


def log_history(lines: DataFrame, job: str, time: str, most: int = 2000) -> DataFrame:
    """The newest `most` lines of each job; time: a column, or a struct of the time and what tells equal times apart."""
    kind = lines.schema[time].dataType
    if kind.typeName() != "struct":
        return ordinals.newest(lines, [job], time, most)
    first, *rest = [F.col(f"{time}.{f}").alias(f"__t{i}") for i, f in enumerate(kind.names)]
    flat = lines.select("*", first, *rest)
    return ordinals.newest(flat, [job], "__t0", most, [f"__t{i + 1}" for i in range(len(rest))]).drop(*[f"__t{i}" for i in range(len(kind.names))])
