"""Mixing sources to target weights by Pareto order sampling.

The size of a document is its number of words. Sources share the total size by weight; a source's target stops
at a multiple of its own size and the excess goes to the others by weight, until none is above. Each document
of a source first gets the certain whole copies, floor(target / size). For the rest, a fixed number of words, documents
are drawn with unequal probabilities: the inclusion probability is proportional to size, pi = min(1, scale * size), with
the scale at which the expected words of the draw are the words to draw, documents at 1 being certain. The scale is
exact, from the counts of each source's distinct sizes. Documents are ranked by random odds over inclusion odds,
u/(1-u) over pi/(1-pi) (certain ones 0), and taken in that order while the words last; the one that crosses the line
is taken if that ends nearer to it.

u comes from md5 of seed, document id and text: reruns agree. No source is ranked in one task: ranks are first
counted in fixed log bins per source, the bin in which the words run out is found from those counts and counted again in
FINE bins, and only rows of one of those, equal ranks summed, are ordered. The result equals that of ordering the whole source.

Cases: a null text has size 0 and is never drawn beyond its whole copies; sources of size 0 have target 0; a null source is
a source of its own, last in order; rows equal in id and text share their random number, so they are drawn together; a null
document id counts as an empty one, its text tells such rows apart; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, cut, text_of

#: Weights that sources take in turn, in code point order.
WEIGHTS = (5, 2, 1)
#: Most times that a document is repeated; also what a target is at most in sizes of its source.
MOST_COPIES = 3
#: Bins per e-fold of the rank, e-folds to either side of 1, and bins of the bin in which the words run out.
BINS, REACH, FINE = 256, 40, 1 << 16


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """sizes(source, source_size, n_docs) with target added. One row per source; shares are found by water-filling:
    in ascending order of cap over weight, a source is capped exactly if its cap is at most its share of what is left.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_need = Window.orderBy("need", F.col("source").isNull(), "source")
    pick = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", pick.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    w = w.withColumn("need", F.col("cap") / F.col("weight")).withColumn("total", F.sum("source_size").over(Window.partitionBy(F.lit(1))).cast("double"))
    w = w.withColumn("caps_before", F.coalesce(F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("weights_left", F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("weights_left"))
    w = w.withColumn("free_level", F.max(F.when(F.col("need") > F.col("level"), F.col("level"))).over(Window.partitionBy(F.lit(1))))
    target = F.when(F.col("need") <= F.col("level"), F.col("cap")).otherwise(F.col("free_level") * F.col("weight"))
    return w.select("source", "source_size", "n_docs", F.coalesce(target, F.lit(0.0)).alias("target"))


def _unit(id_col: Column, text: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 from the document's id and text."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def _rank(u: Column, scale: Column, size: Column) -> Column:
    """Random odds over inclusion odds."""
    pi = scale * size
    return F.when(pi >= 1, 0.0).otherwise((u / (1 - u)) / (pi / (1 - pi)))


def _slim(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    text = text_of(f"`{text_col}`")
    return [F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), count_words(text).alias("size"), _unit(F.col(f"`{id_col}`"), text, seed).alias("u")]


def copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 17) -> DataFrame:
    """One row per input row: its id, mix_size, mix_source, mix_source_size, mix_target, mix_copies. The slim columns only."""
    slim = cut(df.select(*_slim(df, id_col, text_col, source_col, seed)), "mix_sizes")
    params = source_parameters(slim, weights, most)
    rows = _with_parameters(slim.withColumnRenamed("source", "row_source"), params, "row_source")
    return rows.select(F.col("id").alias(id_col), F.col("size").alias("mix_size"), F.col("row_source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), _copies().alias("mix_copies"))


def _copies() -> Column:
    drawn = (F.col("size") > 0) & (F.col("scale") > 0) & (F.col("q") <= F.col("q_cut"))
    return (F.col("whole") + F.when(drawn, 1).otherwise(0)).cast("long")


def _with_parameters(rows: DataFrame, params: DataFrame, source: str) -> DataFrame:
    """rows(id, size, u, source column) with their source's parameters and rank q. Sources are few beside documents; Spark
    broadcasts them below its own size threshold and otherwise joins by key with rows of hot sources split (AQE).
    """
    salts = 32
    p = params.select(F.struct(F.col("source")).alias("pk"), "source_size", "target", "whole", "scale", "budget", "q_cut").withColumn("salt", F.explode(F.array(*map(F.lit, range(salts)))))
    keyed = rows.withColumn("pk", F.struct(F.col(source).alias("source"))).withColumn("salt", F.pmod(F.hash("u"), F.lit(salts)))
    joined = keyed.join(p, keyed.pk.source.eqNullSafe(p.pk.source) & (keyed.salt == p.salt), "left").drop("pk", "salt")
    return joined.withColumn("q", _rank(F.col("u"), F.col("scale"), F.col("size")))


def _scaled(slim: DataFrame, base: DataFrame) -> DataFrame:
    """base with scale: inclusion probabilities are min(1, scale * size) and their expected words the budget; 0 without one.
    Going down the distinct sizes, all larger ones are certain until the scale that is left for the rest keeps this one at 1 or less."""
    sizes = slim.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("source", "s_source")
    rows = sizes.join(base.select("source", "budget").where("budget > 0"), F.col("s_source").eqNullSafe(F.col("source")))
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    words, squares = F.col("size") * F.col("n"), F.col("size").cast("double") * F.col("size") * F.col("n")
    larger = F.coalesce(F.sum(words).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("left", (F.col("budget") - larger) / F.sum(squares).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    found = rows.where(F.col("left") * F.col("size") <= 1).groupBy("source").agg(F.max_by("left", "size").alias("found")).withColumnRenamed("source", "f_source")
    return base.join(found, base.source.eqNullSafe(found.f_source), "left").withColumn("scale", F.greatest(F.lit(0.0), F.coalesce("found", F.lit(0.0)))).drop("f_source", "found")


def _edge(counts: DataFrame, bin_col: str, before: Column) -> DataFrame:
    """Per source, from the words of its bins, in order: q_full and full (rank and words up to which all are taken) and edge, the
    bin in which the budget is passed. before: words taken before the first bin."""
    run = Window.partitionBy("source").orderBy(bin_col)
    counts = counts.withColumn("upto", before + F.sum("words").over(run))
    return counts.groupBy("source").agg(
        F.max(F.when(F.col("upto") <= F.col("budget"), F.col("q_top"))).alias("q_full"),
        F.max(F.when(F.col("upto") <= F.col("budget"), F.col("upto"))).alias("full"),
        F.min(F.when(F.col("upto") > F.col("budget"), F.col(bin_col))).alias("edge"),
    )


def source_parameters(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Per source: source_size, n_docs, target, whole (certain copies), budget (words to draw), scale, q_cut (documents ranked up to it are drawn).
    slim: id, source, size, u of each document."""
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    base = source_targets(sizes, weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = base.withColumn("whole", F.least(F.floor(rate), F.lit(most)).cast("long"))
    base = cut(base.withColumn("budget", F.when(F.col("whole") >= most, 0.0).otherwise(F.col("target") - F.col("whole") * F.col("source_size"))), "mix_sources")
    base = cut(_scaled(slim, base).withColumn("q_cut", F.lit(None).cast("double")), "mix_scales")
    rows = _with_parameters(slim.where("size > 0"), base, "source").where("scale > 0").select("source", "size", "q", "budget")
    at = F.coalesce(F.log("q") * BINS, F.lit(-BINS * REACH))
    place = F.greatest(F.lit(-BINS * REACH), F.least(F.lit(BINS * REACH), F.floor(at)))
    binned = rows.withColumn("at", at).withColumn("bin", place)
    sums = [F.sum("size").alias("words"), F.max("q").alias("q_top"), F.first("budget").alias("budget")]
    coarse = cut(_edge(binned.groupBy("source", "bin").agg(*sums), "bin", F.lit(0)).select(F.col("source").alias("c_source"), F.col("q_full").alias("c_q"), F.coalesce("full", F.lit(0)).alias("c_full"), F.col("edge").alias("c_bin")), "mix_edges")
    fine = F.greatest(F.lit(0), F.least(F.lit(FINE - 1), F.floor((F.col("at") - F.col("bin")) * FINE)))
    inside = binned.join(coarse, binned.source.eqNullSafe(coarse.c_source) & (binned.bin == coarse.c_bin)).select("source", "size", "q", "budget", "c_q", "c_full", fine.alias("fine"))
    inside = cut(inside.groupBy("source", "fine", "q").agg(*sums, F.first("c_q").alias("c_q"), F.first("c_full").alias("c_full")), "mix_edge_rows")
    counts = inside.groupBy("source", "fine").agg(F.sum("words").alias("words"), F.max("q").alias("q_top"), F.first("budget").alias("budget"), F.first("c_full").alias("c_full"))
    finer = _edge(counts, "fine", F.col("c_full")).select(F.col("source").alias("f_source"), F.col("q_full").alias("f_q"), F.col("full").alias("f_full"), F.col("edge").alias("f_bin"))
    last = inside.join(finer, inside.source.eqNullSafe(finer.f_source) & (inside.fine == finer.f_bin))
    run = Window.partitionBy("source").orderBy("q")
    # The document that crosses the line is drawn too if that ends nearer to it.
    near = last.withColumn("upto", F.coalesce("f_full", "c_full") + F.sum("words").over(run)).where(F.col("upto") - F.col("words") / 2 <= F.col("budget"))
    ends = near.groupBy("source").agg(F.max("q").alias("q_last")).withColumnRenamed("source", "l_source")
    cuts = coarse.join(finer.select("f_source", "f_q"), coarse.c_source.eqNullSafe(F.col("f_source")), "left").join(ends, coarse.c_source.eqNullSafe(ends.l_source), "left")
    cuts = cuts.select("c_source", F.coalesce("q_last", "f_q", "c_q").alias("q_found"))
    found = base.drop("q_cut").join(cuts, base.source.eqNullSafe(cuts.c_source), "left")
    return cut(found.withColumn("q_cut", F.coalesce("q_found", F.lit(-1.0))).drop("c_source", "q_found"), "mix_parameters")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 17) -> DataFrame:
    """The mix itself: rows of df, each as often as it was drawn, with df's own columns. Texts are not shuffled unless the
    table of sources is too large to broadcast.
    """
    slim = cut(df.select(*_slim(df, id_col, text_col, source_col, seed)), "mix_sizes")
    params = source_parameters(slim, weights, most)
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *_slim(df, id_col, text_col, source_col, seed))
    rows = whole.select("row", "size", "u", F.col("source").alias("row_source"))
    drawn = _with_parameters(rows, params, "row_source").select("row", _copies().alias("n")).where("n > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k")).select("row.*")
