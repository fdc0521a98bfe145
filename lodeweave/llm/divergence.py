"""Audit of how far sources diverge in their words, by DuckDB over shards of (language, term).

Each task counts its own texts' terms with DuckDB, and sends the counts of each shard as one compressed block; a shard is a
hash of language and term. A shard's task adds the blocks up in SQL and keeps the terms that enough documents of the language
hold. A second pass over the kept counts, again by shard, forms smoothed shares and partial sums for pairs of sources and each
group's best terms; Spark adds the partial sums and ranks.

A pair's value is sum over kept terms of |p_a - p_b|. With p0 the share of a term that a group does not hold, a term that
neither holds gives |p0_a - p0_b|, so the value is V * |p0_a - p0_b| plus corrections for the terms that one or both
hold: shards do work for occurring counts only, not for terms times sources squared.

Nothing is collected. Sources of a language are compared BLOCK at a time: where a language has more, shards are split into
tasks by pairs of source blocks, so a task's sums stay below BLOCK squared per language. SQL runs under MEMORY and spills to
the task's own temporary folder beyond.

Cases: null texts, languages and sources are ''; every (language, source) that occurs takes part, also without terms; a
language without kept terms gives pairs of value 0; repeated rows are documents of their own; equal values rank by UTF-8
order of the item; an empty table gives an empty result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import closing

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_of

#: Documents of a language that must hold a term; ranks of terms that are returned; what is added to each count.
LEAST, TOP, ADDED = 30, 50, 5
#: Shares are whole multiples of one in UNIT.
UNIT = 1_000_000_000
#: Sources of a language that one task compares with as many others.
BLOCK = 512
#: Bytes of texts that are counted together; counts that a task holds before it adds up or sends them; rows of a shard of kept counts.
GROUP, HELD, SHARD = 16_000_000, 1_500_000, 500_000
MEMORY = "400MB"
_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_COUNTS = "lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT"


def _database() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY})
    con.execute("SET preserve_insertion_order = false")
    return con


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _batches(batches: Iterator[pa.RecordBatch], text: int, most: int) -> Iterator[pa.Table]:
    """Batches joined or cut so that their texts have about `most` bytes; a longer text stands alone."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).to_pylist()
        start = 0
        for i, n in enumerate(sizes):
            if size + n > most and (size or i > start):
                held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, i
            size += n
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _add(con: duckdb.DuckDBPyConnection) -> int:
    """Add up the counts of equal keys in place; how many are left."""
    con.execute("CREATE OR REPLACE TABLE sums AS SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM counts GROUP BY ALL")
    con.execute("DROP TABLE counts; ALTER TABLE sums RENAME TO counts")
    return con.sql("SELECT count(*) FROM counts").fetchall()[0][0]


def term_counts(docs: DataFrame, shards: int) -> DataFrame:
    """Each task's counts of its (lang, source, text): rows (shard, block), a block being an Arrow stream of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with closing(_database()) as con:
            con.execute(f"CREATE TABLE counts ({_COUNTS})")

            def send() -> Iterator[pa.RecordBatch]:
                table = con.sql(f"SELECT (hash(lang, term) % {shards})::INT AS shard, * FROM counts ORDER BY shard, lang, term").to_arrow_table()
                con.execute("DELETE FROM counts")
                where, sizes = table.column("shard").combine_chunks().value_counts().flatten() if len(table) else ([], [])
                at = 0
                for shard, n in zip(where, sizes, strict=True):
                    block = _packed(table.slice(at, n.as_py()).drop_columns("shard"))
                    at += n.as_py()
                    yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()], pa.int32()), pa.array([block], pa.binary())], ["shard", "block"])

            held = 0
            for texts in _batches(batches, 2, GROUP):
                con.register("texts", texts)
                held += con.execute(
                    "INSERT INTO counts SELECT lang, source, term, sum(c), count(*) FROM (SELECT rid, lang, source, term, count(*) AS c FROM "
                    f"(SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM (SELECT *, row_number() OVER () AS rid FROM texts)) GROUP BY ALL) GROUP BY ALL"
                ).fetchall()[0][0]
                con.unregister("texts")
                if held > HELD:
                    held = _add(con)
                    if held > HELD // 2:
                        yield from send()
                        held = 0
            _add(con)
            yield from send()

    return docs.mapInArrow(run, "shard int, block binary")


def kept_counts(blocks: DataFrame, least: int) -> DataFrame:
    """Counts (lang, source, term, n, lang_n, first) of the terms in at least `least` documents of their language: lang_n is the
    language's count, first marks one row of each term."""
    schema = "lang string, source string, term string, n long, lang_n long, first int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with closing(_database()) as con:
            con.execute(f"CREATE TABLE counts ({_COUNTS})")
            held = 0
            for batch in batches:
                for block in batch.column(1):
                    con.register("block", pa.ipc.open_stream(block.as_buffer()).read_all())
                    held += con.execute("INSERT INTO counts SELECT * FROM block").fetchall()[0][0]
                    con.unregister("block")
                    if held > 2 * HELD:
                        held = min(_add(con), HELD)
            _add(con)
            found = con.sql(
                "WITH t AS (SELECT lang, term, sum(n)::BIGINT AS lang_n, min(source) AS least FROM counts GROUP BY ALL "
                f"HAVING sum(docs) >= {least}) SELECT c.lang, c.source, c.term, c.n, t.lang_n, (c.source = t.least)::INT AS first FROM counts c JOIN t ON c.lang = t.lang AND c.term = t.term"
            )
            yield from found.to_arrow_reader()

    return blocks.repartition("shard").mapInArrow(run, schema)


_SHARE = f"1 + {UNIT}::HUGEINT * ({{n}} + {ADDED}) // ({{of}} + {ADDED}::HUGEINT * g.v)"
#: In a tag of two source blocks the pairs are those across; in a tag of one block all of its pairs.
_ACROSS = "(a.block <> b.block OR a.tag_lo = a.tag_hi)"
_SHARD_SQL = f"""
CREATE TEMP TABLE g AS SELECT *, ({_SHARE.format(n=0, of="total")})::BIGINT AS p0 FROM rows g WHERE term IS NULL;
CREATE TEMP TABLE r AS SELECT r.tag_lo, r.tag_hi, r.shard, r.lang, r.source, r.block, r.term, g.p0, ({_SHARE.format(n="r.n", of="g.total")})::BIGINT AS p, ({_SHARE.format(n="r.lang_n", of="g.lang_total")})::BIGINT AS q
  FROM rows r JOIN g ON r.tag_lo = g.tag_lo AND r.tag_hi = g.tag_hi AND r.shard = g.shard AND r.lang = g.lang AND r.source = g.source WHERE r.term IS NOT NULL;
CREATE TEMP TABLE one AS SELECT a.lang, least(a.source, b.source) AS lo, greatest(a.source, b.source) AS hi, sum(abs(a.p - b.p0) - abs(a.p0 - b.p0))::BIGINT AS v
  FROM r a JOIN g b ON a.tag_lo = b.tag_lo AND a.tag_hi = b.tag_hi AND a.shard = b.shard AND a.lang = b.lang AND a.source <> b.source AND {_ACROSS} GROUP BY ALL;
CREATE TEMP TABLE two AS SELECT a.lang, a.source AS lo, b.source AS hi, sum(abs(a.p - b.p) - abs(a.p - b.p0) - abs(a.p0 - b.p) + abs(a.p0 - b.p0))::BIGINT AS v
  FROM r a JOIN r b ON a.tag_lo = b.tag_lo AND a.tag_hi = b.tag_hi AND a.shard = b.shard AND a.lang = b.lang AND a.term = b.term AND a.source < b.source AND {_ACROSS} GROUP BY ALL;
"""


def _shard_sums(rows: DataFrame, top: int) -> DataFrame:
    """(part, lang, source, item, value): partial sums of pairs, and the `top` terms of each group in the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with closing(_database()) as con:
            created = False
            for batch in batches:
                con.register("batch", pa.Table.from_batches([batch]))
                con.execute("INSERT INTO rows SELECT * FROM batch" if created else "CREATE TABLE rows AS SELECT * FROM batch")
                con.unregister("batch")
                created = True
            if not created:
                return
            con.execute(_SHARD_SQL)
            yield from con.sql("SELECT 'pair' AS part, lang, lo AS source, hi AS item, sum(v)::BIGINT AS value FROM (FROM one UNION ALL FROM two) GROUP BY ALL").to_arrow_reader()
            yield from con.sql(
                "SELECT 'term' AS part, lang, source, term AS item, p - q AS value FROM r WHERE tag_lo = tag_hi AND p > q "
                f"QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {top}"
            ).to_arrow_reader()

    return rows.mapInArrow(run, "part string, lang string, source string, item string, value long")


def divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """Per group (lang, source): part 'pair', each other source of the language by falling distance, and part 'term', its `top`
    most over-used terms: lang, source, part, item, value, rank."""
    spark = df.sparkSession
    docs = df.select(text_of(f"`{lang_col}`").alias("lang"), text_of(f"`{source_col}`").alias("source"), text_of(f"`{text_col}`").alias("text"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = cut(kept_counts(term_counts(docs, shards), least), "kept_counts")

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("first").alias("v"), F.sum("n").alias("lang_total"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("total", "v", "lang_total")}
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").withColumns(zero)
    groups = cut(groups, "groups")
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    blocks = -(-most // block)
    own = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    # shards of kept counts, and each shard's groups beside them
    parts = max(shards, -(-kept.count() // SHARD))
    tags = (F.least("block", "other").alias("tag_lo"), F.greatest("block", "other").alias("tag_hi"))
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("term", "string"), ("n", "long"), ("lang_n", "long"))]
    sizes = [F.lit(None).cast("long").alias(c) for c in ("total", "v", "lang_total")]
    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(parts)).cast("int").alias("shard")
    counts = kept.select("*", own.alias("block"), others.alias("other")).select(*tags, shard, "lang", "source", "block", "term", "n", "lang_n", *sizes)
    beside = groups.where("v > 0").select("*", own.alias("block"), others.alias("other")).select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("shard"))
    beside = beside.select(*tags, "shard", "lang", "source", "block", *empty, "total", "v", "lang_total")
    sums = cut(_shard_sums(counts.unionByName(beside).repartition(parts * blocks, "shard", "tag_lo", "tag_hi"), top), "shard_sums")

    # pairs: what terms that neither holds would give, then the corrections
    p0 = F.when(F.col("v") > 0, F.expr(f"1 + (cast({UNIT * ADDED} as decimal(20, 0)) div (total + cast({ADDED} as decimal(20, 0)) * v))")).otherwise(0).cast("long")
    left = groups.select("lang", F.col("source").alias("lo"), "v", p0.alias("p_lo"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = groups.select("lang", F.col("source").alias("hi"), p0.alias("p_hi"), own.alias("block"))
    base = left.join(right, ["lang", "block"]).where("lo < hi").select("lang", "lo", "hi", (F.col("v") * F.abs(F.col("p_lo") - F.col("p_hi"))).alias("value"))
    found = sums.where("part = 'pair'").select("lang", F.col("source").alias("lo"), F.col("item").alias("hi"), "value")
    pairs = base.unionByName(found).groupBy("lang", "lo", "hi").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("lo").alias("source"), F.col("hi").alias("item")), F.struct(F.col("hi").alias("source"), F.col("lo").alias("item"))))
    pairs = pairs.select("lang", "value", ways.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    terms = sums.where("part = 'term'").select("lang", "source", "part", "item", "value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", place).unionByName(terms.withColumn("rank", place).where(F.col("rank") <= top))
