"""Personal data: generators of candidate spans, gradient-boosted trees over their features, calibrated thresholds.
DataFrame functions only.

Four generators with a check each give the base spans: `email`, `ip` (parts at most 255), `card` (14 to 19 digits,
Luhn) and `phone` (a plus and 10 to 15 digits). Generators of higher recall propose more, also overlapping, spans:
`mail_words` (name at host dot tld), `phone_local` (national ten-digit numbers) and `ssn`. A candidate's features are
small numbers: generator, digits, separators, different characters, the characters on either side, and whether it passes
its generator's check.

What the trees learn is not the check but whether a hint word of the candidate's kind ("call", "ssn", ...) stands just
before it; hint words are withheld from the features. How often each combination of features occurs, and how often with
a hint, is counted over all documents, apart for those trained on and one part in HELD_OUT that is not. That table has at
most CELLS rows whatever the input, so it is what the driver fits the boosted trees on: depth-limited regression trees on
logistic loss, weighted by counts. Each kind's threshold is calibrated on the documents held out: the least score from
which on the share of candidates with a hint is `precision`, and LIFT times the share that candidates failing their
checks have by chance; a kind with fewer than LEAST_SEEN such candidates has none and adds nothing. Base spans always stay;
of the other generators' candidates those are added that reach their kind's threshold and overlap no base span.

Places come from what a pattern finds and the text between its finds, so they count code points. They are running sums,
taken in chunks of CHUNK and chunks of chunks, and overlaps are told from running ends, so a text of a million finds costs
a million steps, not their square; redaction cuts a text in stretches of REACH code points first for the same reason.
Patterns run only on texts that hold a character they need. Cases: a null or empty text has no spans; ids may be null or repeated,
each row is searched alone; with no candidates at all there are no trees and nothing is added; an empty table gives
an empty result; other columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_of

#: Generators in order: name, pattern (Java), what a text must hold. The first four give base spans. Repeated groups are
#: possessive: nothing that follows needs them to give back, and Java then loops instead of recursing once per repeat.
_LOCAL = "A-Za-z0-9._%+-"
GENERATORS = (
    ("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"text rlike '[0-9]\\.[0-9]'"),
    ("card", r"[0-9](?:[ -]?[0-9])++", "text rlike '[0-9][ -]?[0-9]'"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "contains(text, '+')"),
    ("mail_words", r"(?<![A-Za-z0-9])[A-Za-z0-9._%+-]{2,40} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{2,40}(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{2,40}){1,4}", "(contains(text, '(at)') or contains(text, '[at]'))"),
    ("phone_local", r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", "text rlike '[0-9]{3}[ .-][0-9]{4}'"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "text rlike '-[0-9]{2}-'"),
)
BASE = 4
KINDS = tuple(g[0] for g in GENERATORS)
#: Words that announce each generator's kind when they stand within HINT_REACH characters before a candidate.
HINTS = {
    "email": "mail|contact|write|reach",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|mastercard|amex|account|payment",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|contact",
    "mail_words": "mail|contact|write|reach",
    "phone_local": "phone|tel|telephone|call|mobile|cell|fax|contact",
    "ssn": "ssn|social|security|taxpayer",
}
HINT_REACH = 24
#: Values of each feature: generator, digits, separators, different characters, left, right, check; parts of documents.
SHAPE = (len(GENERATORS), 8, 5, 3, 4, 3, 2)
CELLS = 2 * math.prod(SHAPE)
ROUNDS, DEPTH, RATE = 24, 3, 0.3
#: One document in so many calibrates; share of hints above a threshold; times the chance share; candidates needed.
HELD_OUT, PRECISION, LIFT, LEAST_SEEN = 4, 0.5, 3.0, 10
#: Finds that are summed one by one, before sums of chunks are; code points of a stretch.
CHUNK, REACH = 128, 512

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
def _digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _checked(kind: str, m: Column) -> Column:
    """Whether a candidate of this kind is well formed. The first four decide on base spans."""
    if kind == "ip":
        return m.rlike(f"^{_BYTE}(?:[.]{_BYTE}){{3}}$")
    if kind == "card":
        return let(_digits_of(m), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits_of(m)).between(10, 15)
    if kind == "mail_words":
        return m.rlike("[A-Za-z]{2,}$")
    if kind == "phone_local":
        return m.rlike("^[(]?[2-9][0-9]{2}[^0-9]+[2-9]")
    if kind == "ssn":
        return ~(m.rlike("^(?:000|666|9)") | m.rlike("-00-") | m.rlike("0000$"))
    return F.lit(True)


def _few(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of a few values what op makes of zero and those before it. Each step copies the array so far."""
    none = F.array().cast("array<bigint>")
    start = F.struct(zero.alias("now"), none.alias("got"))
    return F.aggregate(values, start, lambda a, x: F.struct(op(a["now"], x).alias("now"), F.array_append(a["got"], a["now"]).alias("got")), lambda a: a["got"])


def running(values: Column, zero: int, op: Callable[[Column, Column], Column], levels: int = 3) -> Column:
    """For each of the values (bigint) what op, an associative function, makes of zero and all values before it."""
    nought = F.lit(zero).cast("bigint")
    if levels == 1:
        return _few(values, nought, op)

    def whole(v: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")))
        return let(F.transform(places, lambda c: F.slice(v, c * CHUNK + 1, F.lit(CHUNK))), of_chunks)

    def of_chunks(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, nought, lambda a, b: op(a, b)))
        return let(running(sums, zero, op, levels - 1), lambda before: F.flatten(F.transform(chunks, lambda c, i: F.transform(_few(c, nought, op), lambda x: op(F.get(before, i), x)))))

    return let(values, whole)


_CAND = "array<struct<start:bigint,ord:int,end:bigint,kind:string,hinted:boolean,f1:int,f2:int,f3:int,f4:int,f5:int,f6:int>>"


def _proposed(at: int) -> Column:
    """Array of (start, ord, end, kind, hinted, f1..f6) that one generator finds in the column `text`."""
    kind, pattern, needs = GENERATORS[at]
    p = F.lit(pattern)

    def placed(f: Column) -> Column:
        lengths = F.transform(f["found"], lambda m, i: (F.length(F.get(f["gaps"], i)) + F.length(m)).cast("bigint"))
        return let(running(lengths, 0, lambda a, b: a + b), lambda before: F.transform(f["found"], lambda m, i: cand(f, before, m, i)))

    def cand(f: Column, before: Column, m: Column, i: Column) -> Column:
        gap, after = F.get(f["gaps"], i), F.get(f["gaps"], i + 1)
        parts = F.struct(m.alias("m"), (F.get(before, i) + F.length(gap)).alias("s"), F.right(gap, F.lit(HINT_REACH)).alias("gap"), F.left(after, F.lit(1)).alias("right"), F.length(F.regexp_replace(m, "[^0-9]", "")).alias("digits"))
        return let(parts, shape)

    def shape(x: Column) -> Column:
        m, s, digits, left, right = x["m"], x["s"], x["digits"], F.right(x["gap"], F.lit(1)), x["right"]
        size = F.when(digits == 0, 0).when(digits < 9, 1).when(digits == 9, 2).when(digits == 10, 3).when(digits < 14, 4).when(digits < 17, 5).when(digits < 20, 6).otherwise(7)
        kinds = F.size(F.array_distinct(F.split(F.regexp_replace(F.left(m, F.lit(200)), "[^A-Za-z0-9]", ""), "")))
        return F.struct(
            s.alias("start"),
            F.lit(at).alias("ord"),
            (s + F.length(m)).alias("end"),
            F.lit(kind).alias("kind"),
            F.lower(x["gap"]).rlike(f"(?:^|[^a-z])(?:{HINTS[kind]})(?![a-z])").alias("hinted"),
            size.alias("f1"),
            F.least(F.lit(4), F.length(F.regexp_replace(m, "[A-Za-z0-9]", ""))).alias("f2"),
            F.when(kinds < 3, 0).when(kinds < 6, 1).otherwise(2).alias("f3"),
            F.when((left == "") | left.rlike(r"[\s(\[\"':=,;]"), 0).when(left.rlike("[A-Za-z]"), 1).when(left.rlike("[0-9]"), 2).otherwise(3).alias("f4"),
            F.when((right == "") | right.rlike(r"[\s)\]\"',;.:!?]"), 0).when(right.rlike("[A-Za-z0-9]"), 1).otherwise(2).alias("f5"),
            let(m, lambda v: _checked(kind, v)).cast("int").alias("f6"),
        )

    found = F.struct(F.regexp_extract_all("text", p, F.lit(0)).alias("found"), F.split("text", pattern, -1).alias("gaps"))
    none = F.array().cast(_CAND)
    return F.when(F.expr(needs), let(found, lambda f: F.when(F.size(f["found"]) == 0, none).otherwise(placed(f)))).otherwise(none)


def propose(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df as struct `row`, its text as `text` (null: empty), and `cands`, all generators' candidates."""
    docs = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), text_of(f"`{text_col}`").alias("text"))
    return docs.select("row", "text", F.concat(*[_proposed(i) for i in range(len(GENERATORS))]).alias("cands"))


_FEATURES = ("ord", "f1", "f2", "f3", "f4", "f5", "f6")


class Trees:
    """Boosted regression trees on logistic loss. A tree is a number or (feature, value, tree if <= value, tree if above)."""

    def __init__(self, cells: list[tuple[tuple[int, ...], float, float]], held_out: list[tuple[tuple[int, ...], float, float]] = (), rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, precision: float = PRECISION):
        """cells: (features, candidates, those with a hint), to train on and to calibrate on."""
        self.trees: list = []
        self.thresholds: dict[int, float] = {}
        total, good = sum(c[1] for c in cells), sum(c[2] for c in cells)
        if not total:
            self.base = 0.0
            return
        share = (good + 0.5) / (total + 1)
        self.base = math.log(share / (1 - share))
        scores = [self.base] * len(cells)
        for _ in range(rounds):
            chance = [1 / (1 + math.exp(-s)) for s in scores]
            grads = [c[2] - c[1] * p for c, p in zip(cells, chance, strict=True)]
            hess = [c[1] * p * (1 - p) for c, p in zip(cells, chance, strict=True)]
            tree = self._grow(cells, grads, hess, list(range(len(cells))), depth, rate)
            self.trees.append(tree)
            scores = [s + self._value(tree, c[0]) for s, c in zip(scores, cells, strict=True)]
        noise = [c for c in held_out if not c[0][-1]]
        chance = (sum(c[2] for c in noise) + 0.5) / (sum(c[1] for c in noise) + 1) if noise else 0.0
        least = max(precision, min(0.95, LIFT * chance))
        for kind in range(BASE, len(GENERATORS)):
            seen = hinted = 0.0
            own = sorted(((self.score(c[0]), c[1], c[2]) for c in held_out if c[0][0] == kind), reverse=True)
            for i, (score, n, k) in enumerate(own):
                seen, hinted = seen + n, hinted + k
                if seen >= LEAST_SEEN and hinted >= least * seen and (i + 1 == len(own) or own[i + 1][0] < score):
                    self.thresholds[kind] = score

    def _grow(self, cells, grads, hess, rows, depth, rate):
        g, h = sum(grads[i] for i in rows), sum(hess[i] for i in rows)
        best = (1e-6, None)
        if depth:
            for f in range(len(_FEATURES)):
                sums: dict[int, list[float]] = {}
                for i in rows:
                    s = sums.setdefault(cells[i][0][f], [0.0, 0.0])
                    s[0] += grads[i]
                    s[1] += hess[i]
                gl = hl = 0.0
                for value in sorted(sums)[:-1]:
                    gl, hl = gl + sums[value][0], hl + sums[value][1]
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if gain > best[0]:
                        best = (gain, (f, value))
        if best[1] is None:
            return rate * g / (h + 1)
        f, value = best[1]
        low = [i for i in rows if cells[i][0][f] <= value]
        high = [i for i in rows if cells[i][0][f] > value]
        return f, value, self._grow(cells, grads, hess, low, depth - 1, rate), self._grow(cells, grads, hess, high, depth - 1, rate)

    def _value(self, tree, features) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, features: tuple[int, ...]) -> float:
        """Log odds."""
        return self.base + sum(self._value(t, features) for t in self.trees)

    def sql(self, of: str) -> str:
        """The score as SQL over a struct of features."""

        def text(tree) -> str:
            if not isinstance(tree, tuple):
                return f"{tree!r}D"
            return f"case when {of}.{_FEATURES[tree[0]]} <= {tree[1]} then {text(tree[2])} else {text(tree[3])} end"

        return " + ".join([f"{self.base!r}D", *(f"({text(t)})" for t in self.trees)])


def fit(df: DataFrame, text_col: str = "text", precision: float = PRECISION) -> Trees:
    """Trees from the candidates of all rows; at most CELLS rows of counts reach the driver."""
    # explode_outer: for explode Spark would first test the array's size, and so search each text twice
    docs = propose(df.select(F.col(f"`{text_col}`").alias("text")), "text")
    cells = docs.select((F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0).alias("held_out"), F.explode_outer("cands").alias("c")).where("c is not null")
    counts = cells.groupBy("held_out", *[F.col(f"c.{f}").alias(f) for f in _FEATURES]).agg(F.count(F.lit(1)).alias("n"), F.count_if("c.hinted").alias("hinted")).collect()
    parts = [sorted((tuple(r[f] for f in _FEATURES), float(r.n), float(r.hinted)) for r in counts if r.held_out == part) for part in (False, True)]
    return Trees(*parts, precision=precision)


_FAR = 2**62


def _plain(c: Column) -> Column:
    return F.struct(*[c[f].alias(f) for f in ("start", "ord", "end", "kind")])


def _clear(spans: Column) -> Column:
    """Of ordered spans the base ones, and those of others that overlap no base one."""
    is_base = lambda s: s["ord"] < BASE
    ends = F.transform(spans, lambda s: F.when(is_base(s), s["end"]).otherwise(F.lit(0).cast("bigint")))
    starts = F.reverse(F.transform(spans, lambda s: F.when(is_base(s), s["start"]).otherwise(F.lit(_FAR).cast("bigint"))))
    borders = F.struct(running(ends, 0, F.greatest).alias("before"), F.reverse(running(starts, _FAR, F.least)).alias("after"))
    free = lambda b: F.filter(spans, lambda s, i: is_base(s) | ((F.get(b["before"], i) <= s["start"]) & (F.get(b["after"], i) >= s["end"])))
    return let(borders, free)


def find(df: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """Columns row (df's), text, base and spans: arrays of (start, ord, end, kind), ordered by start, then kind."""
    cands = propose(df, text_col)
    base = F.sort_array(F.transform(F.filter("cands", lambda c: (c["ord"] < BASE) & (c["f6"] == 1)), _plain))
    docs = cands.select("row", "text", "cands", base.alias("base"))
    if not model.thresholds:
        return docs.select("row", "text", "base", F.col("base").alias("spans"))
    reached = " or ".join(f"(c.ord = {kind} and ({model.sql('c')}) >= {least!r}D)" for kind, least in model.thresholds.items())
    more = F.transform(F.expr(f"filter(cands, c -> {reached})"), _plain)
    docs = docs.select("row", "text", "base", more.alias("more"))
    spans = F.when(F.size("more") == 0, F.col("base")).otherwise(let(F.sort_array(F.concat("base", "more")), _clear))
    return docs.select("row", "text", "base", spans.alias("spans"))


def _stretch(chunks: Column, start: Column, end: Column) -> Column:
    """The text from start to end, out of its chunks of REACH code points."""
    a, b = (F.floor(x / REACH).cast("int") for x in (start, end))
    at, to = (start % REACH).cast("int"), (end % REACH).cast("int")
    one = F.substring(F.get(chunks, a), at + 1, to - at)
    tail = F.substring(F.coalesce(F.get(chunks, b), F.lit("")), F.lit(1), to)
    several = F.concat(F.substring(F.get(chunks, a), at + 1, F.lit(REACH)), F.array_join(F.slice(chunks, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), tail)
    return F.when(start >= end, F.lit("")).when(a == b, one).otherwise(several)


def redact(text: str = "text", spans: str = "spans") -> Column:
    """The text of find()'s rows with each span, or stretch of overlapping spans, replaced by [KIND] of its first."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{REACH}}}"), F.lit(0)).alias("chunks"), running(F.transform(spans, lambda s: s["end"]), 0, F.greatest).alias("before"))

    def joined(x: Column) -> Column:
        heads = F.filter(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), F.get(x["before"], i).alias("reach"))), lambda h: h["start"] >= h["reach"])
        pieces = F.transform(heads, lambda h: F.concat(_stretch(x["chunks"], h["reach"], h["start"]), F.lit("["), F.upper(h["kind"]), F.lit("]")))
        rest = _stretch(x["chunks"], F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text).cast("bigint"))
        return F.concat(F.array_join(pieces, ""), rest)

    return F.when(F.size(spans) == 0, F.col(text)).otherwise(let(parts, joined))


def scrub(df: DataFrame, text_col: str = "text", count_col: str | None = "n_chars", precision: float = PRECISION) -> DataFrame:
    """df with personal data in its texts replaced; count_col holds the new length. Model fitted on df itself."""
    found = find(df, fit(df, text_col, precision), text_col).withColumn("clean", redact())
    out = []
    for c in df.columns:
        old = F.col(f"row.`{c}`")
        if c == text_col:
            old = F.when(old.isNotNull(), F.col("clean").cast(df.schema[c].dataType))
        elif c == count_col:
            old = F.when(old.isNotNull(), F.length("clean").cast(df.schema[c].dataType))
        out.append(old.alias(c))
    return found.select(*out)
