"""A contact record per job that pages fill in one by one, as a stream with state of its own.

Each field keeps the value of the earliest page (by its number) that has one, so the record does not depend on the order in which
micro-batches bring the pages; an icon from a fallback service gives way to any real one. State is a map from field to
(page number, value, whether it is a fallback), kept in RocksDB, dropped after `ttl` without use. The batch form is
catalogue.first_non_empty().
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ContactRecord(StatefulProcessor):
    """rows (job, seq, field, value, fallback) -> the job's record after each batch: its fields and the number of batches so far."""

    def __init__(self, key: str, fields: Sequence[str], ttl_ms: int | None):
        self.key, self.fields, self.ttl_ms = key, list(fields), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        kept = T.StructType([T.StructField("seq", T.LongType()), T.StructField("value", T.StringType()), T.StructField("fallback", T.BooleanType())])
        self.record = handle.getMapState("record", T.StructType([T.StructField("field", T.StringType())]), kept, self.ttl_ms)
        self.version = handle.getValueState("version", T.StructType([T.StructField("n", T.LongType())]), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = {}
        for part in rows:
            for seq, field, value, fallback in part[["seq", "field", "value", "fallback"]].itertuples(index=False):
                found = (bool(fallback), int(seq), value)
                if field not in best or found < best[field]:
                    best[field] = found
        out = {self.key: key[0]}
        for field in self.fields:
            own = self.record.getValue((field,)) if self.record.containsKey((field,)) else None
            old = (bool(own[2]), int(own[0]), own[1]) if own is not None else None
            new = min((x for x in (old, best.get(field)) if x is not None), default=None)
            if new is not None and new != old:
                self.record.updateValue((field,), (new[1], new[2], new[0]))
            out[field] = new[2] if new is not None else None
        n = (int(self.version.get()[0]) if self.version.exists() else 0) + 1
        self.version.update((n,))
        yield pd.DataFrame([out | {"version": n}])

    def close(self) -> None:
        pass


def contact_records(pages: DataFrame, key: str, seq: str, fields: Sequence[str], icon: str | None = None, fallback_mark: str = "", ttl_ms: int | None = None) -> DataFrame:
    """A stream of pages (key, seq, fields) to key, fields and `version` (its highest is the job's record so far), for output
    mode update. Values that are null or blank are no values; trimmed. icon: the field in which a value that contains
    fallback_mark gives way to others."""
    spark = pages.sparkSession
    spark.conf.set(_PROVIDER, _ROCKSDB)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.col(f).cast("string")).alias("value"), (F.col(f).contains(fallback_mark) if f == icon and fallback_mark else F.lit(False)).alias("fallback")) for f in fields])
    rows = pages.select(key, F.col(seq).cast("long").alias("seq"), F.explode(pairs).alias("p")).select(key, "seq", "p.*").where("value is not null and value <> ''")
    schema = T.StructType([rows.schema[key], *(T.StructField(f, T.StringType()) for f in fields), T.StructField("version", T.LongType())])
    return rows.groupBy(key).transformWithStateInPandas(ContactRecord(key, fields, ttl_ms), schema, "update", "processingTime" if ttl_ms else "none")


def newest_records(rows: DataFrame, key: str) -> DataFrame:
    """Of the rows that the stream has put out, each key's last record."""
    rest = [c for c in rows.columns if c not in (key, "version")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(key, "r.*")


def restore_provider(spark: SparkSession, provider: str | None) -> None:
    """Set the state store back to what it was before contact_records()."""
    if provider is None:
        spark.conf.unset(_PROVIDER)
    else:
        spark.conf.set(_PROVIDER, provider)
