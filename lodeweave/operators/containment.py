"""Set containment as equi-joins, and the clean-up of duplicates that their master subsumes.

Sets come as rows (id, element), never as arrays, so a set may be as long as it likes. Sets of the same elements are one class.
A set can only lie in sets that hold its rarest element: that element is joined with an inverted index of the larger sets. Sizes and
signs (each element sets one of 64 bits, twice over) stand in the index and prune there, before anything is shuffled; what is left is
confirmed element by element. A set of n elements has at most (all rows / n) candidates, as they must
have n elements too, so confirming costs a set no more than one pass over the index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.shared import cut

#: Words of 64 bits that sum up a set's elements.
SIGNS = 2


def _sets(rows: DataFrame, id_col: str, element_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, element without nulls and repeats; id, size, h1, h2 and signs s0, ... of each set), both from one shuffle by id. h1 and h2
    are 64-bit hashes of the elements, all of them joined by exclusive or; each element sets one bit of each sign."""
    each = rows.select(F.col(id_col).alias("id"), F.col(element_col).alias("element")).where("element is not null").repartition("id").distinct()
    joined = lambda seed: F.bit_xor(F.xxhash64("element", F.lit(seed)))
    signs = [F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(element, {seed}), 64) as int))")).alias(f"s{i}") for i, seed in enumerate(range(3, 3 + SIGNS))]
    return each, each.groupBy("id").agg(F.count(F.lit(1)).alias("size"), joined(1).alias("h1"), joined(2).alias("h2"), *signs)


def classes(rows: DataFrame, id_col: str, element_col: str) -> DataFrame:
    """id, size and class (least id of the sets with the same elements) of each set; null elements are left out. Sets are told
    apart by their size and two 64-bit hashes joined over their elements."""
    sets = _sets(rows, id_col, element_col)[1].select("id", "size", "h1", "h2")
    least = sets.groupBy("size", "h1", "h2").agg(F.min("id").alias("class"))
    return sets.join(least, ["size", "h1", "h2"]).select("id", "size", "class")


def contained(small: DataFrame, large: DataFrame, id_col: str, element_col: str) -> DataFrame:
    """Pairs (small, large) of sets, one of each class, such that the large set holds all elements of the small one; a set is not
    paired with its own id. Members of classes are those of classes(). Sets without elements take no part."""
    s = _representatives(small, id_col, element_col)
    t = s if large is small else _representatives(large, id_col, element_col)
    found_in = t.groupBy("element").agg(F.count(F.lit(1)).alias("n"))
    signs = [f"s{i}" for i in range(SIGNS)]
    asked = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "element")
    rarest = s.join(found_in, "element", "left").groupBy(F.col("id").alias("small")).agg(F.min(asked).alias("r"), F.first("size").alias("small_size"), *[F.first(c).alias(f"small_{c}") for c in signs]).where("r.n > 0")
    rarest = rarest.select("small", "small_size", *[f"small_{c}" for c in signs], F.col("r.element").alias("element"))
    # sizes and signs are compared where the rarest element's row of the index is met, so that few pairs leave it
    holds = (F.col("small") != F.col("large")) & (F.col("size") >= F.col("small_size"))
    for c in signs:
        holds = holds & (F.col(f"small_{c}").bitwiseAND(F.bitwise_not(c)) == 0)
    pairs = rarest.join(t.withColumnRenamed("id", "large"), "element").where(holds).select("small", "large", "small_size")
    pairs = cut(pairs, "open_pairs")
    open_pairs = pairs.where("small_size > 1")
    met = open_pairs.join(s.select(F.col("id").alias("small"), "element"), "small").join(t.select(F.col("id").alias("large"), "element"), ["large", "element"])
    met = met.groupBy("small", "large", "small_size").agg(F.count(F.lit(1)).alias("n"))
    return pairs.where("small_size = 1").select("small", "large").unionByName(met.where("n = small_size").select("small", "large"))


def _representatives(rows: DataFrame, id_col: str, element_col: str) -> DataFrame:
    """A row per element of one set of each class, with the set's size and signs, written once."""
    each, sets = _sets(rows, id_col, element_col)
    least = sets.groupBy("size", "h1", "h2").agg(F.min_by(F.struct("id", *[f"s{i}" for i in range(SIGNS)]), "id").alias("x")).select("size", "x.*")
    return cut(each.join(least, "id"), "set_elements")


def masters(df: DataFrame, group: Sequence[str], id_col: str, score: Column, created: str, flagged: str | None = None) -> DataFrame:
    """id and master of every row in a group of several: the flagged row, else by score, age and id. One aggregation, joined
    back; rows with a null in their group have none."""
    flag = F.coalesce(F.col(flagged), F.lit(False)) if flagged else F.lit(False)
    order = F.struct((~flag).alias("f"), F.when(flag, 0).otherwise(-score).alias("s"), F.col(created).alias("c"), F.col(id_col).alias("i"))
    best = df.groupBy(*group).agg(F.min(order).alias("__best"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return df.join(best, list(group)).select(F.col(id_col).alias("id"), F.col("__best.i").alias("master"))


def cleaned_up(df: DataFrame, id_col: str, pairs: DataFrame, equal: Sequence[str] = (), present: Sequence[str] = (), relations: Sequence[tuple[DataFrame, str, str]] = ()) -> DataFrame:
    """id, master and action of each duplicate in pairs(id, master): `archive` if its master subsumes it, else `link`. It does
    if every column in `equal` (numbers, addresses) that the duplicate has is the same there, every column in `present` (texts,
    dates) that it has is not empty there, and, for each relation (rows, key, value), its values stand among the master's."""
    pairs = pairs.where(F.col("id") != F.col("master"))
    columns = list(dict.fromkeys([*equal, *present]))
    own = df.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"__d_{c}") for c in columns])
    theirs = df.select(F.col(id_col).alias("master"), *[F.col(c).alias(f"__m_{c}") for c in columns])
    filled = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    holds = F.lit(True)
    for c in equal:
        holds = holds & (F.col(f"__d_{c}").isNull() | F.coalesce(F.col(f"__d_{c}") == F.col(f"__m_{c}"), F.lit(False)))
    for c in present:
        holds = holds & (~F.coalesce(filled(f"__d_{c}"), F.lit(False)) | F.coalesce(filled(f"__m_{c}"), F.lit(False)))
    judged = pairs.join(own, "id").join(theirs, "master").select("id", "master", holds.alias("__holds"))
    for rows, key, value in relations:
        links = rows.select(F.col(key).alias("__k"), F.col(value).alias("__v")).where("__v is not null").distinct()
        extra = pairs.join(links, F.col("id") == F.col("__k")).select("id", F.col("master").alias("__k"), "__v").join(links, ["__k", "__v"], "left_anti")
        judged = judged.join(extra.select("id").distinct().withColumn("__extra", F.lit(True)), "id", "left").withColumn("__holds", F.col("__holds") & F.col("__extra").isNull()).drop("__extra")
    return judged.select("id", "master", F.when(F.col("__holds"), "archive").otherwise("link").alias("action"))
