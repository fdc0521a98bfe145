"""Formulas over a record and its related records: dates, ordered values, counts, and texts of property bags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unit of date_between -> seconds.
UNITS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400, "weeks": 604800}


def date_between(later: Column, earlier: Column, unit: str = "minutes") -> Column:
    """Whole units from the earlier to the later time, rounded towards zero."""
    seconds = F.unix_seconds(later.cast("timestamp")) - F.unix_seconds(earlier.cast("timestamp"))
    return (F.sign(seconds) * F.floor(F.abs(seconds) / UNITS[unit])).cast("long")


def date_start(span: Column) -> Column:
    """Start of a struct(start, end)."""
    return span["start"]


def date_end(span: Column) -> Column:
    """End of a struct(start, end), the start where there is none."""
    return F.coalesce(span["end"], span["start"])


def format_date(time: Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.date_format(time, pattern)


def timestamp_ms(time: Column) -> Column:
    """Milliseconds since 1970."""
    return F.unix_millis(time.cast("timestamp"))


def to_millis(time: Column) -> Column:
    """The time to the nearest whole millisecond, halves up."""
    micros = F.unix_micros(time.cast("timestamp")) + 500
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(1000)))


def starts_with_date(text: Column) -> Column:
    """Whether a cell's text begins with a date as YYYY-MM-DD."""
    return F.coalesce(F.trim(text), F.lit("")).rlike(r"^\d{4}-\d{2}-\d{2}")


def short_year(date: Column) -> Column:
    """Two digits of the year of a text YYYY-MM-DD; null for others."""
    return F.when(starts_with_date(date), F.substring(F.trim(date), 3, 2))


def stamped(df: DataFrame, column: str, now: Column | None = None) -> DataFrame:
    """df with a null time set to now (the query's time unless given)."""
    return df.withColumn(column, F.coalesce(F.col(column), now if now is not None else F.current_timestamp()))


def related(df: DataFrame, key: str, links: DataFrame, order: str, value: str) -> DataFrame:
    """df with `items`, the related rows' values in order, of links(key, order, value); empty for none. A record's relations
    are a list that people keep, so a list per record is what the source itself holds."""
    items = links.groupBy(F.col(key).alias("__k")).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias("items"))
    none = F.array().cast(items.schema["items"].dataType)
    return df.join(items, F.col(key) == F.col("__k"), "left").drop("__k").withColumn("items", F.coalesce("items", none))


def first_of(items: Column) -> Column:
    return F.get(items, F.lit(0))


def joined(items: Column, between: str = ", ") -> Column:
    return F.array_join(items, between)


def total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))


def formatted(value: Column, digits: int = 0) -> Column:
    """A number as text with a fixed number of digits, ties away from zero."""
    return F.format_string(f"%.{digits}f", value.cast("double"))


def any_empty(*values: Column) -> Column:
    """Whether a value is null or an empty text."""
    out = F.lit(False)
    for v in values:
        out = out | v.isNull() | (v.cast("string") == "")
    return out


def ratio(part: Column, whole: Column, digits: int | None = None) -> Column:
    """part / whole, 0 for a whole of 0 or null; rounded half away from zero if wished."""
    r = F.when(F.coalesce(whole, F.lit(0)) == 0, 0.0).otherwise(part / whole)
    return r if digits is None else F.round(r, digits)


def discounted(price: Column, discount: Column) -> Column:
    """price less a share of it; the price itself for no discount."""
    return price * (1 - F.coalesce(discount, F.lit(0)))


def progress(rolled: DataFrame, share: str = "percent_checked", unchecked: str = "unchecked", n: str = "n") -> DataFrame:
    """rollup() rows with `progress`, the checked share, and `state`: done, open (nothing checked) or partly."""
    state = F.when(F.col(unchecked) == 0, "done").when(F.col(unchecked) == F.col(n), "open").otherwise("partly")
    return rolled.withColumn("progress", F.col(share)).withColumn("state", state)


def bag_text(parts: Column, default: str | None = None) -> Column:
    """The text of a property: its parts' plain_text one after the other, trimmed; the default where that is empty."""
    text = F.trim(F.array_join(F.transform(parts, lambda p: F.coalesce(p["plain_text"], F.lit(""))), ""))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default if default is not None else ""))


def task_text(title: Column, notes: Column) -> Column:
    """Title, line end, notes, trimmed."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return strip(F.concat(strip(F.coalesce(title, F.lit(""))), F.lit("\n"), strip(F.coalesce(notes, F.lit("")))))


def with_children(df: DataFrame, key: str, parent: str, done: Column) -> DataFrame:
    """df with n_children and the share of them that are done (0 for none), of a table that refers to itself."""
    children = df.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("__p")).agg(F.count(F.lit(1)).alias("n_children"), F.avg(done.cast("int")).alias("done_share"))
    return df.join(children, F.col(key) == F.col("__p"), "left").drop("__p").na.fill({"n_children": 0, "done_share": 0.0})


def first_filled(df: DataFrame, group: str, key: str, column: str, others: list[str]) -> DataFrame:
    """Per group the column and others of the row with the least key that has the column."""
    row = F.struct(column, *others)
    return df.groupBy(group).agg(F.min_by(row, F.when(F.col(column).isNotNull(), F.col(key))).alias("x")).select(group, "x.*")


def histogram(df: DataFrame, column: str, names: DataFrame, key: str, name: str) -> DataFrame:
    """name, n of each of a dimension's rows, by descending n, with the rows in all and those that have one."""
    n = df.groupBy(F.col(column).alias("__c")).agg(F.count(F.lit(1)).alias("n"))
    sums = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(column).alias("n_assigned"))
    counted = names.join(n, F.col(key) == F.col("__c"), "left").select(F.col(name), F.coalesce("n", F.lit(0)).alias("n"))
    # one row of totals
    return counted.join(F.broadcast(sums)).orderBy(F.desc("n"), name)


def reset(df: DataFrame, when: Column, changes: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(df with the changes where the condition holds, n_rows and n_reset)."""
    hit = F.coalesce(when, F.lit(False))
    done = df.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in df.columns])
    return done, df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(hit).alias("n_reset"))
