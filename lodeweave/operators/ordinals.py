"""Numbers of rows within a key, and a key's newest rows, without ranking a whole key in one task.

A window over a key sorts all of its rows in one task, however many there are. numbered() sorts by (key, order) over range
partitions instead, which split a large key, counts within each partition and adds how many of the key's rows lie in
partitions before it. newest() counts rows by bins of time, finds the bin that the cut falls in, bins that one again, and
ranks only the rows of the last bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.shared import cut

#: Rows of a range partition, about.
PART_ROWS = 2_000_000


def _named(columns: Sequence[str | Column], prefix: str) -> list[Column]:
    return [(F.col(c) if isinstance(c, str) else c).alias(f"{prefix}{i}") for i, c in enumerate(columns)]


def numbered(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column], name: str, parts: int | None = None) -> DataFrame:
    """df with `name`, each row's number (long, from 1) within its key, in ascending order of `order`; nulls come first, and nulls in a
    key make a key. Rows that are equal in order are numbered in any order. parts: range partitions, by default as many as the rows
    fill and at least the session's shuffle partitions."""
    spark, kept = df.sparkSession, df.columns
    k, o = _named(keys, "__k"), _named(order, "__o")
    key, by = [f"__k{i}" for i in range(len(k))], [f"__o{i}" for i in range(len(o))]
    rows = df.select("*", *k, *o).withColumn("__tie", F.monotonically_increasing_id())
    if parts is None:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PART_ROWS))
    dealt = rows.repartitionByRange(parts, *key, *by, "__tie").withColumn("__part", F.spark_partition_id())
    # the partition is written down, as range borders are sampled anew whenever a plan runs; a key's rows in one partition are few
    placed = cut(dealt.withColumn("__key", F.struct(*key)).drop(*key), "ordinals")
    place = F.row_number().over(Window.partitionBy("__part", "__key").orderBy(*by, "__tie"))
    placed = placed.withColumn("__n", place.cast("long"))
    # of each partition its first and last key, and how many rows of these it has: one row a partition
    counts = cut(placed.groupBy("__part", "__key").agg(F.count(F.lit(1)).alias("n")), "ordinal_counts")
    least = F.min(F.struct("__key")).alias("first"), F.max(F.struct("__key")).alias("last"), F.max_by("n", F.struct("__key")).alias("n_last"), F.count(F.lit(1)).alias("keys")
    edges = counts.groupBy("__part").agg(*least).orderBy("__part").collect()
    before, carried, open_key = [], 0, None
    for e in edges:
        before.append((e["__part"], carried if open_key is not None and e["first"] == open_key else 0))
        carried = e.n_last + (before[-1][1] if e["keys"] == 1 else 0)
        open_key = e["last"]
    shift = spark.createDataFrame(before, "__part int, __before long") if before else spark.createDataFrame([], "__part int, __before long")
    firsts = counts.groupBy("__part").agg(F.min(F.struct("__key"))["__key"].alias("__first"))
    shift = firsts.join(shift, "__part")
    found = placed.join(F.broadcast(shift), "__part")  # a row a partition
    number = F.col("__n") + F.when(F.col("__key").eqNullSafe(F.col("__first")), F.col("__before")).otherwise(F.lit(0).cast("long"))
    return found.withColumn(name, number).select(*kept, name)


#: Bins of a key's stretch of time.
BINS = 1024


def newest(df: DataFrame, keys: Sequence[str], time: str | Column, most: int, ties: Sequence[str] = ()) -> DataFrame:
    """The rows with a key's `most` latest times; of equal times those with the largest `ties`, null times last. time: a number, date or
    timestamp."""
    kept, key = df.columns, [f"__k{i}" for i in range(len(keys))]
    t = F.col(time) if isinstance(time, str) else time
    kind = df.select(t.alias("t")).schema["t"].dataType.typeName()
    at = F.unix_micros(t.cast("timestamp")).cast("double") if kind in ("timestamp", "timestamp_ntz", "date") else t.cast("double")
    rows = df.select("*", *_named(list(keys), "__k"), F.coalesce(at, F.lit(float("-inf"))).alias("__at"))
    above, edge = None, rows.withColumn("__need", F.lit(most).cast("long"))
    for _ in range(2):  # a bin, and a bin of that bin
        real = F.when(F.col("__at") > float("-inf"), F.col("__at"))
        bounds = edge.groupBy(*key).agg(F.min(real).alias("__lo"), F.max(real).alias("__hi"))
        share = (F.col("__at") - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
        inner = F.when(F.col("__at") == float("-inf"), -1).otherwise(F.least(F.lit(BINS - 1), F.floor(F.coalesce(share, F.lit(0.0)) * BINS))).cast("int")
        binned = _same_keys(edge, bounds, key).withColumn("__bin", inner).drop("__lo", "__hi")
        sizes = binned.groupBy(*key, "__bin").agg(F.count(F.lit(1)).alias("n"), F.max("__need").alias("need"))
        upto = F.sum("n").over(Window.partitionBy(*key).orderBy(F.desc("__bin")))
        # the lowest bin that is needed, and how many rows of it: at most BINS + 1 rows a key are ranked here
        cuts = sizes.withColumn("upto", upto).where("upto - n < need").groupBy(*key).agg(F.min("__bin").alias("__cut"), F.min_by(F.col("need") - F.col("upto") + F.col("n"), "__bin").alias("__left"))
        met = _same_keys(binned, cuts, key)
        whole = met.where("__bin > __cut").drop("__bin", "__cut", "__left", "__need")
        above = whole if above is None else above.unionByName(whole)
        edge = cut(met.where("__bin = __cut").withColumn("__need", F.col("__left")).drop("__bin", "__cut", "__left"), "newest_edge")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("__at"), *[F.desc(c) for c in ties]))
    last = edge.withColumn("__n", place).where("__n <= __need").drop("__n", "__need")
    return above.unionByName(last).select(*kept)


def _same_keys(rows: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """rows with the table's columns, nulls in keys being equal."""
    other = table.withColumnsRenamed({k: f"{k}_" for k in key})
    on = F.lit(True)
    for k in key:
        on = on & rows[k].eqNullSafe(other[f"{k}_"])
    return rows.join(other, on).drop(*[f"{k}_" for k in key])
