"""Quality rules with cross-document line frequency. DataFrame functions only.

Lines are normalised (case of letters, digits read as 0, white space folded) and hashed. Per host, each line's
distinct documents are counted, documents of the same text counting once. A line is over the limit if more
than `line_share` of its host's distinct documents, and more than `line_floor` of them, hold it. Such lines are
removed; a document that keeps less than `least_left` of its words is depleted and rejected. Beside this, a
document fails the base rules if it has few words or if most of them lie in repeated 3-word windows.

The lines of a document are made distinct before they leave the row, and counts are summed before the shuffle,
so a line that a third of all documents hold costs one row per task. Under a share, at most (lines per document /
line_share) lines of a host can be over the limit; with a share of 0 their number grows with the host. The table of
those lines is broadcast only if its checked size allows, and otherwise joined with the texts' lines by salted (host,
line), which gives each text its own lines over the limit, joined back by (host, text hash).

Cases: a null text has no words and fails; a null host is a host of its own; null and repeated ids stay as they
are, each row judged alone (equal rows alike); an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACE_CLASS, cut, text_of, words_of

#: A line over both is removed from its host's documents; without a share the limit is the same on hosts of any size.
LINE_SHARE, LINE_FLOOR = 0.0, 20
#: A document that keeps a smaller share of its words is rejected.
LEAST_LEFT = 0.3
#: Lines over the limit that are broadcast at most, and those of one host; beyond, they are joined by salted (host, line).
MOST_BROADCAST, MOST_LISTED = 200_000, 1000
SALTS = 32


def normal_line(line: Column) -> Column:
    """What counts as the same line."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), f"[{SPACE_CLASS}]+", " "))


def line_hashes(text: Column) -> Column:
    """Hash of each line of a text, in order; null for lines without a word."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(F.btrim(x, F.lit(SPACE_CHARS)) != "", F.xxhash64(normal_line(x))))


def host_lines(df: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """host, doc (hash of the text) and lines (distinct line hashes): each text once per host."""
    docs = df.select(F.col(host_col).cast("string").alias("host"), text_of(text_col).alias("text"))
    # Documents of one text count once per host. Only hashes are shuffled: (host, text hash) picks one copy's lines.
    lines = docs.select("host", _doc("text").alias("doc"), F.array_distinct(F.filter(line_hashes(F.col("text")), lambda x: x.isNotNull())).alias("lines"))
    return lines.groupBy("host", "doc").agg(F.first("lines").alias("lines"))


def _doc(text: str) -> Column:
    return F.xxhash64(text, F.lit(1))


def frequent_lines(one: DataFrame, line_share: float = LINE_SHARE, line_floor: int = LINE_FLOOR) -> DataFrame:
    """host and line: the hashes of the lines over their host's limit, from host_lines(). A share of 0 leaves the number alone as the limit."""
    sizes = one.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = one.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > line_floor)
    s = sizes.withColumnRenamed("host", "s_host")
    return counts.join(s, counts.host.eqNullSafe(s.s_host)).where(F.col("n") > F.col("n_docs") * line_share).select("host", "line")


def lines_over(one: DataFrame, limits: DataFrame) -> DataFrame:
    """l_host, l_doc and over: which lines of a text are over the limit, for texts with any. A line that many documents
    hold is met in SALTS places."""
    lim = limits.select(F.col("host").alias("l_host"), F.col("line").alias("l_line"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("l_salt"))
    lines = one.select("host", "doc", F.pmod("doc", F.lit(SALTS)).cast("int").alias("salt"), F.explode("lines").alias("line"))
    met = lines.join(lim, (lines.line == lim.l_line) & (lines.salt == lim.l_salt) & lines.host.eqNullSafe(lim.l_host))
    return met.groupBy(F.col("host").alias("l_host"), F.col("doc").alias("l_doc")).agg(F.collect_list("line").alias("over"))


def repeated_words(words: Column) -> Column:
    """Number of words that lie in 3-word windows found twice or more, the first included; words: an array column's name.

    Windows are sorted as (hash, place) packed in one long, 40 and 24 bits; neighbours that agree are looked at again
    with the whole hash. Each repeated window covers three words from its place, less what the next one covers.
    """
    w = words
    full = f"xxhash64({w}[i], {w}[i+1], {w}[i+2])"
    packed = f"sort_array(transform(sequence(0, size({w})-3), i -> shiftleft({full}, 24) | cast(i as bigint)))"
    twice = "filter(s, (x, j) -> (j > 0 and shiftright(x, 24) = shiftright(s[j-1], 24)) or (j + 1 < size(s) and shiftright(x, 24) = shiftright(s[j+1], 24)))"
    # (whole hash, place) of those, then places whose whole hash stands twice
    again = f"sort_array(transform(t, x -> struct({full.replace('[i', '[cast(x & 16777215 as int)')} as h, cast(x & 16777215 as int) as i)))"
    places = "sort_array(transform(filter(u, (x, j) -> (j > 0 and x.h = u[j-1].h) or (j + 1 < size(u) and x.h = u[j+1].h)), x -> x.i))"
    covered = "aggregate(p, struct(0L as n, -3 as last), (a, x) -> struct(a.n + least(3, x - a.last) as n, x as last), a -> a.n)"
    nest = f"transform(array({packed}), s -> {twice})[0]"
    nest = f"transform(array({nest}), t -> {again})[0]"
    nest = f"transform(array({nest}), u -> {places})[0]"
    nest = f"transform(array({nest}), p -> {covered})[0]"
    wide = f"transform(array(sort_array(transform(sequence(0, size({w})-3), i -> struct({full} as h, i)))), u -> {places})[0]"
    wide = f"transform(array({wide}), p -> {covered})[0]"
    return F.expr(f"case when size({w}) < 4 then 0L when size({w}) < 16777216 then {nest} else {wide} end")


def judge(df: DataFrame, text_col: str = "text", host_col: str = "source", line_share: float = LINE_SHARE, line_floor: int = LINE_FLOOR, least_left: float = LEAST_LEFT) -> DataFrame:
    """df's rows as struct `row`, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    clean_text (the text without lines over the limit), n_left (its words) and kept.
    """
    one = cut(host_lines(df, text_col, host_col), "host_lines")
    limits = cut(frequent_lines(one, line_share, line_floor), "frequent_lines")
    total, longest = limits.groupBy("host").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    docs = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(host_col).cast("string").alias("host"), text_of(text_col).alias("text"))
    if total <= MOST_BROADCAST and longest <= MOST_LISTED:
        over = limits.groupBy(F.col("host").alias("l_host")).agg(F.sort_array(F.collect_list("line")).alias("over"))
        docs = docs.join(F.broadcast(over), docs.host.eqNullSafe(over.l_host), "left")
    else:
        over = cut(lines_over(one, limits), "lines_over")
        docs = docs.withColumn("doc", _doc("text"))
        docs = docs.join(over, (docs.doc == over.l_doc) & docs.host.eqNullSafe(over.l_host), "left")
    docs = docs.select("row", "text", "over", words_of(F.col("text")).alias("words"), F.split("text", "\n").alias("lines"))
    seen = F.filter("lines", lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    left = F.when(F.col("over").isNull(), F.col("text")).otherwise(F.array_join(F.filter("lines", lambda x: ~F.coalesce(F.array_contains("over", F.xxhash64(normal_line(x))), F.lit(False)) | (F.btrim(x, F.lit(SPACE_CHARS)) == "")), "\n"))
    docs = docs.select(
        "row", "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        seen.alias("seen"),
        repeated_words("words").cast("long").alias("n_repeat_words"),
        left.alias("clean_text"),
        F.col("over").isNotNull().alias("limited"),
    )
    docs = docs.select("row", "text", "n_words", "word_chars", "n_symbols", (F.size("seen") - F.size(F.array_distinct("seen"))).cast("long").alias("n_dup_lines"), "n_repeat_words", "clean_text", F.when(F.col("limited") & (F.col("clean_text") != F.col("text")), F.regexp_count("clean_text", F.lit(f"[^{SPACE_CLASS}]+")).cast("long")).otherwise(F.col("n_words")).alias("n_left"))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    # The last condition always holds; not being deterministic, it keeps filters on `kept` from being pushed below, where
    # the arrays would be made anew for each element that a lambda looks at.
    kept = ~failed & (F.col("n_left") >= F.col("n_words") * least_left) & (F.monotonically_increasing_id() >= 0)
    return docs.select("*", failed.alias("base_failed"), kept.alias("kept")).drop("text")


def scrub(df: DataFrame, text_col: str = "text", host_col: str = "source", count_col: str | None = "n_chars", **limits) -> DataFrame:
    """df without rejected documents, their texts without lines over the limit; count_col holds the new length."""
    judged = judge(df, text_col, host_col, **limits).where("kept")
    out = []
    for c in df.columns:
        old = F.col(f"row.`{c}`")
        if c == text_col:
            old = F.when(old.isNotNull(), F.col("clean_text").cast(df.schema[c].dataType))
        elif c == count_col:
            old = F.when(old.isNotNull(), F.length("clean_text").cast(df.schema[c].dataType))
        out.append(old.alias(c))
    return judged.select(*out)
