"""From names to ids: lookups by slug or name, owners by fallback, and re-maps. All are equi-joins on distinct names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import text as tx
from lodeweave.operators import ordinals


def named(dim: DataFrame, value: str, slug: str | Column = "slug", name: str = "name") -> DataFrame:
    """Rows of a dimension whose slug is that of the value, or whose name is the value, letters' case aside."""
    own = F.col(slug) if isinstance(slug, str) else slug
    return dim.where((own == tx.slug(F.lit(value))) | (F.lower(name) == value.lower()))


def ids_of(df: DataFrame, label: str, dim: DataFrame, key: str, name: str, alias: str, slug: str | None = None) -> DataFrame:
    """df with the least id of the dimension's rows that `label` names by slug or by name (case aside); null for none."""
    labels = df.select(F.col(label).alias("__l")).where("__l is not null").distinct()
    d = dim.select(F.col(key).alias("__id"), (F.col(slug) if slug else tx.slug(F.col(name))).alias("__slug"), F.lower(name).alias("__name"))
    by_slug = labels.join(d, tx.slug(F.col("__l")) == F.col("__slug")).select("__l", "__id")
    by_name = labels.join(d, F.lower("__l") == F.col("__name")).select("__l", "__id")
    found = by_slug.unionByName(by_name).groupBy("__l").agg(F.min("__id").alias(alias))
    return df.join(found, F.col(label) == F.col("__l"), "left").drop("__l")


def any_of_parent(df: DataFrame, own: str, parent: str, dim: DataFrame, key: str, parent_key: str) -> DataFrame:
    """df with `own`, where it is null, set to the least row of the dimension that has df's parent."""
    first = dim.groupBy(F.col(parent_key).alias("__p")).agg(F.min(key).alias("__first"))
    return df.join(first, F.col(parent) == F.col("__p"), "left").withColumn(own, F.coalesce(own, "__first")).drop("__p", "__first")


def owners(df: DataFrame, steps: Sequence[tuple[str, DataFrame, str, str, str]]) -> DataFrame:
    """For each (column, dimension, its key, its owner column, owner column in df) in order: df's owner, where it is null,
    is what the row that the column points at names. So a type gives its category and a category its workspace."""
    for fk, dim, key, owner, own in steps:
        d = dim.select(F.col(key).alias("__k"), F.col(owner).alias("__o"))
        df = df.join(d, F.col(fk) == F.col("__k"), "left").withColumn(own, F.coalesce(own, "__o")).drop("__k", "__o")
    return df


def remap(df: DataFrame, column: str, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """df with the column's values replaced where the mapping (one row per old value) has them; others stay."""
    m = mapping.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    return df.join(m, F.col(column) == F.col("__old"), "left").withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")


def where_in(df: DataFrame, column: str, chosen: DataFrame, key: str) -> DataFrame:
    """Rows whose column stands among the chosen rows' keys."""
    return df.join(chosen.select(F.col(key).alias("__c")), F.col(column) == F.col("__c"), "left_semi")


def relabelled(df: DataFrame, column: str, old: str, new: Column) -> DataFrame:
    """df with a column worked out anew where it holds the old label."""
    return df.withColumn(column, F.when(F.col(column) == old, new).otherwise(F.col(column)))


def renamed(dim: DataFrame, updates: DataFrame, key: str, name: str = "name", slug: str = "slug") -> DataFrame:
    """A dimension with updates(key, name, slug): a given name replaces the old one; the slug is the given one, else that of
    the new name, else stays."""
    u = updates.select(F.col(key).alias("__k"), F.col(name).alias("__n"), F.col(slug).alias("__s"))
    j = dim.join(u, F.col(key) == F.col("__k"), "left")
    made = F.coalesce(F.col("__s"), F.when(F.col("__n").isNotNull(), tx.slug(F.col("__n"))), F.col(slug))
    return j.withColumns({slug: made, name: F.coalesce("__n", name)}).select(*dim.columns)


def relinked(links: DataFrame, key: str, value: str, given: DataFrame) -> DataFrame:
    """A bridge table in which the keys of given(key, values) have exactly the given values; others keep theirs."""
    kept = links.join(given.select(key).distinct(), key, "left_anti")
    return kept.unionByName(given.select(key, F.explode(F.array_distinct("values")).alias(value)))


def grown(stored: DataFrame, found: DataFrame, job: str, url: str, most: str | None = None) -> DataFrame:
    """One step of a growing frontier: stored(job, url, ...) and those found(job, url, pos, ...) that are new, in order of
    pos, as long as the job has fewer than `most` (a column of found; null or 0: no limit) rows."""
    new = found.groupBy(job, url).agg(F.min_by(F.struct(*[c for c in found.columns if c not in (job, url)]), "pos").alias("x")).select(job, url, "x.*")
    new = new.join(stored.select(job, url), [job, url], "left_anti")
    if most:
        sizes = stored.groupBy(job).agg(F.count(F.lit(1)).alias("__n"))
        free = F.coalesce(F.col(most), F.lit(0)) <= 0
        new = ordinals.numbered(new, [job], ["pos"], "__place").join(sizes, job, "left").where(free | (F.coalesce("__n", F.lit(0)) + F.col("__place") <= F.col(most))).drop("__n", "__place", most)
    return stored.unionByName(new.drop("pos"), allowMissingColumns=True)


def first_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, that with the least `order` (rows without one last). Minima are combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    least = F.min_by(F.struct(*rest), F.struct(F.col(order).isNull(), F.col(order)))
    return df.groupBy(key).agg(least.alias("__row")).select(key, "__row.*").select(*df.columns)


def session_batches(df: DataFrame, key: str | Column, order: str | Column, size: int = 40, name: str = "session") -> DataFrame:
    """df with the number (from 0) of the session that a row falls in: a key's rows in order, `size` at a time."""
    placed = ordinals.numbered(df, [key], [order], name)
    return placed.withColumn(name, F.floor((F.col(name) - 1) / size).cast("long"))


def listing(df: DataFrame, order: Sequence[str | Column], where: dict[str, object] | None = None, limit: int | None = None) -> DataFrame:
    """Rows that equal every given value (null or `all`: any; a list: one of them), in order, the first `limit` of them."""
    for column, value in (where or {}).items():
        if isinstance(value, (list, tuple, set)):
            df = df.where(F.col(column).isin(*value))
        elif value is not None and value != "all":
            df = df.where(F.col(column) == F.lit(value))
    df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def by_key(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key; no row where there is none."""
    return df.where(F.col(key) == F.lit(value))
