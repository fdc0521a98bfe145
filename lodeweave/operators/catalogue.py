"""Catalogue operations: enrichment joins, hierarchical counts, duplicate election and merging, upserts, deletion, roll-ups.

Dimensions are joined plainly: Spark broadcasts them below its own size threshold and sorts and merges beyond, so no
hint promises a size that nobody checked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.operators import ordinals


def optional_filter(df: DataFrame, column: str, value: str | int | None, known: DataFrame | None = None, slug_col: str = "slug", id_col: str = "id", strict: bool = False) -> DataFrame:
    """Equality filter unless the value is null, `all` or `__all__`. A text column is compared as text. For others a number
    is the id, and a slug is looked up in `known`; an unknown one drops the filter, or with strict=True gives no rows."""
    if value is None or value in ("all", "__all__", ""):
        return df
    if df.schema[column].dataType.typeName() == "string" and known is None:
        return df.where(F.col(column) == str(value))
    if isinstance(value, int) or str(value).isdigit():
        return df.where(F.col(column) == int(value))
    found = known.where(F.col(slug_col) == value).select(F.min(id_col)).first()[0] if known is not None else None
    if found is None:
        return df.limit(0) if strict else df
    return df.where(F.col(column) == found)


def enrich(df: DataFrame, dims: Sequence[tuple[DataFrame, str, str, str, str]]) -> DataFrame:
    """Left join of each (dimension, its key, its name column, key in df, name in the result)."""
    for dim, key, name, fk, alias in dims:
        df = df.join(dim.select(F.col(key).alias("__k"), F.col(name).alias(alias)), F.col(fk) == F.col("__k"), "left").drop("__k")
    return df


def tree_counts(df: DataFrame, levels: Sequence[str], name: str = "n") -> DataFrame:
    """The number of rows below every node of a tree of columns, from the root (all null) to the last level."""
    return df.rollup(*levels).agg(F.count(F.lit(1)).alias(name))


def best_of(df: DataFrame, key: str, order: Sequence[Column], fields: Sequence[str]) -> DataFrame:
    """key and the fields of its best row, the least in `order` (such as: not a real title, not the root address, not completed,
    id). One aggregation with map-side combine."""
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return df.groupBy(key).agg(F.min_by(F.struct(*fields), place).alias("__best")).select(key, "__best.*")


def gather(links: DataFrame, key: str, value: str, alias: str) -> DataFrame:
    """key and the sorted distinct values linked to it."""
    return links.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias(alias))


def with_counts(dim: DataFrame, key: str, facts: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """dim with, for each (fact table, foreign key, name), the number of rows; 0 for none."""
    for fact, fk, alias in facts:
        n = fact.groupBy(F.col(fk).alias("__k")).agg(F.count(F.lit(1)).alias(alias))
        dim = dim.join(n, F.col(key) == F.col("__k"), "left").drop("__k").withColumn(alias, F.coalesce(alias, F.lit(0)))
    return dim


def insert_if_absent(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """table and those rows whose keys it lacks; of rows that repeat a key any one."""
    fresh = rows.dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti")
    return table.unionByName(fresh, allowMissingColumns=True)


def reconcile(stored: DataFrame, seen: DataFrame, key: str = "url", lastmod: str = "lastmod", status: str = "status", again: str | None = None) -> DataFrame:
    """key, lastmod, status, action of a re-visit: new and failed rows, those flagged in the column `again` (untitled or
    empty pages) and those with a later lastmod are pending, a lastmod never seen is filled in, all others stay as they are."""
    flag = F.coalesce(F.col(again), F.lit(False)) if again else F.lit(False)
    s = stored.select(F.col(key).alias("k"), F.col(lastmod).alias("old"), F.col(status).alias("was"), flag.alias("redo"))
    n = seen.select(F.col(key).alias("n"), F.col(lastmod).alias("new"), F.lit(True).alias("here"))
    j = s.join(n, F.col("k") == F.col("n"), "full_outer")
    action = (
        F.when(F.col("k").isNull(), "insert").when(F.col("here").isNull(), "keep").when((F.col("was") == "failed") | F.col("redo"), "retry").when(F.col("new") > F.col("old"), "refresh").when(F.col("old").isNull() & F.col("new").isNotNull(), "fill").otherwise("keep")
    )
    j = j.withColumn("action", action)
    pending = F.col("action").isin("insert", "retry", "refresh")
    return j.select(F.coalesce("k", "n").alias(key), F.when(F.col("action").isin("insert", "refresh", "fill"), F.col("new")).otherwise(F.col("old")).alias(lastmod), F.when(pending, "pending").otherwise(F.col("was")).alias(status), "action")


def set_or_keep(df: DataFrame, updates: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Partial update: updates hold key and, per field, struct(is_set, value); a field that is set takes the value, null
    included, all others keep theirs."""
    u = updates.select(F.col(key).alias("__k"), *[F.col(f).alias(f"__{f}") for f in fields])
    j = df.join(u, F.col(key) == F.col("__k"), "left")
    changed = {f: F.when(F.coalesce(F.col(f"__{f}.is_set"), F.lit(False)), F.col(f"__{f}.value")).otherwise(F.col(f)) for f in fields}
    return j.withColumns(changed).select(*df.columns)


def unlink(df: DataFrame, gone: DataFrame, fk: str, key: str) -> DataFrame:
    """df with fk null where it points at a deleted row."""
    g = gone.select(F.col(key).alias("__g")).distinct()
    return df.join(g, F.col(fk) == F.col("__g"), "left").withColumn(fk, F.when(F.col("__g").isNull(), F.col(fk))).drop("__g")


def cascade_delete(df: DataFrame, gone: DataFrame, fk: str, key: str) -> DataFrame:
    """df without rows that point at a deleted row."""
    return df.join(gone.select(F.col(key).alias(fk)).distinct(), fk, "left_anti")


def elect(df: DataFrame, group: Sequence[str | Column], score: Column, created: str, id_col: str, flagged: str | None = None) -> DataFrame:
    """df with `place` in its group: a flagged row first, then by score, age and id; 1 is the master."""
    flag = [F.when(F.col(flagged), 0).when(~F.col(flagged), 1).otherwise(2)] if flagged else []
    return ordinals.numbered(df, list(group), [*flag, F.coalesce(-score, F.lit(float("inf"))), created, id_col], "place")


def merge_duplicates(df: DataFrame, group: Sequence[str], score: Column, created: str, id_col: str, fields: Sequence[str]) -> DataFrame:
    """One row per group: the master's id, and each field from the first row by place that has it. One aggregation with
    map-side combine; no group is gathered."""
    place = F.struct((-score).alias("s"), F.col(created).alias("c"), F.col(id_col).alias("i"))
    filled = [F.min_by(F.col(f), F.when(F.col(f).isNotNull(), place)).alias(f) for f in fields]
    return df.groupBy(*group).agg(F.min(place).alias("__m"), F.count(F.lit(1)).alias("n_rows"), *filled).withColumn("master_id", F.col("__m.i")).drop("__m")


def is_subset(small: Column, large: Column) -> Column:
    """Whether all values of one array stand in another."""
    return F.size(F.array_except(small, large)) == 0


def first_non_empty(df: DataFrame, key: str, seq: str, fields: Sequence[str], fallbacks: dict[str, Column] | None = None) -> DataFrame:
    """Per key each field's first value in order of seq that is neither null nor blank, trimmed. fallbacks: for a field the condition
    under which its value (such as an icon of a fallback service) counts only where there is no other."""
    picked = []
    for f in fields:
        value = F.trim(F.col(f).cast("string"))
        last = F.coalesce((fallbacks or {}).get(f, F.lit(False)), F.lit(False))
        picked.append(F.min_by(value, F.when(value.isNotNull() & (value != ""), F.struct(last.alias("l"), F.col(seq).alias("s")))).alias(f))
    return df.groupBy(key).agg(*picked)


def job_status(pages: DataFrame, job: str, status: str) -> DataFrame:
    """Per job: n_pages, n_done (completed or failed), n_completed, n_failed, n_pending and the job's status."""
    s = F.col(status)
    a = pages.groupBy(job).agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(s.isin("completed", "failed")).alias("n_done"), F.count_if(s == "completed").alias("n_completed"), F.count_if(s == "failed").alias("n_failed"), F.count_if(s == "pending").alias("n_pending"))
    return a.withColumn("status", F.when(F.col("n_pending") == 0, "completed").otherwise("paused"))


def explorer(pages: DataFrame, categories: DataFrame, types: DataFrame) -> DataFrame:
    """category_id, type_id (null: pages without a type), n_pages, category_total. pages(category_id, type_id),
    categories(category_id), types(type_id, category_id). A page whose type belongs to another category is in neither count."""
    listed = types.select("category_id", "type_id").unionByName(categories.select("category_id").withColumn("type_id", F.lit(None).cast(types.schema["type_id"].dataType)))
    n = pages.groupBy("category_id", "type_id").agg(F.count(F.lit(1)).alias("n")).withColumnsRenamed({"category_id": "pc", "type_id": "pt"})
    j = listed.join(n, listed.category_id.eqNullSafe(n.pc) & listed.type_id.eqNullSafe(n.pt), "left").select("category_id", "type_id", F.coalesce("n", F.lit(0)).alias("n_pages"))
    return j.withColumn("category_total", F.sum("n_pages").over(Window.partitionBy("category_id")))


#: Rows of a partition of rollup, about.
ROLLUP_ROWS = 200_000


def rollup(links: DataFrame, key: str, value: str, flag: str, order: str | None = None) -> DataFrame:
    """Per key: count, sum, share of checked rows, unchecked rows, distinct values. With an order a key's values are added in that
    order, so that a sum of doubles is the same however the rows are dealt (n_unique aside, which regroups them).

    Rows are dealt by key to as many partitions as they fill, ROLLUP_ROWS each, so that a task's memory does not grow with the input,
    and distinct values need no shuffle of their own."""
    needed = [key, value, flag] + ([order] if order is not None else [])
    parts = max(links.sparkSession.sparkContext.defaultParallelism, -(-links.count() // ROLLUP_ROWS))
    links = links.select(*dict.fromkeys(needed)).repartition(parts, key)
    if order is not None:
        links = links.sortWithinPartitions(key, order)  # Spark keeps a sort below a sum of doubles
    return links.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(F.col(flag).cast("int")).alias("percent_checked"), F.count_if(~F.col(flag)).alias("unchecked"), F.count_distinct(value).alias("n_unique"))


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both, columns of either; missing ones are null."""
    return old.unionByName(new, allowMissingColumns=True)


def token_lookup(df: DataFrame, id_col: str, tokens: Column, names: DataFrame, name: str, value: str) -> DataFrame:
    """id and the value of the first token that is a name, letters' case aside."""
    t = df.select(F.col(id_col), F.posexplode(tokens).alias("pos", "token"))
    n = names.select(F.lower(F.col(name)).alias("__n"), F.col(value).alias(value))
    return t.join(n, F.lower("token") == F.col("__n")).groupBy(id_col).agg(F.min_by(value, F.struct("pos", F.col(value))).alias(value))
