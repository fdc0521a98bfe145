"""Secret scan: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

Patterns find three kinds, each leftmost and non-overlapping: `assign` (a key word, = or :, a value of 12 characters
or more), `access` (AKIA and capitals or digits, 18 or more in all) and `hex` (16 or more hex digits).

The battery looks at every other run of 16 or more characters of [A-Za-z0-9+/_=-] that holds a letter, and at its parts:
the run is parted at '=', those parts at '/', and at the characters of either base64 alphabet that the other lacks; each
of all these is also taken without a leading key name or path of plain words. Every part of 16 or more characters is a
candidate of its own and counts as a test of its own. Of accepted candidates that lie in each other the longest is
reported; stretches of the two base64 alphabets may overlap without one lying in the other (a_b/c holds a_b and b/c), and
then both are. The smallest of hex, base32, base36 and base64 that fits is its inferred encoding.

Three statistics are taken of a candidate: chi-squared of the symbol counts against an even alphabet, runs above and below
the alphabet's middle (Wald-Wolfowitz), and lag-one serial correlation. The null hypothesis is written text, as this
table writes it: pairs of neighbouring characters are counted over all texts, runs aside, together with a short fixed
text for tables without prose, and give each alphabet's symbol shares, share of changes of side and serial correlation,
hence mean and spread of each statistic for text of any length. A test's p is the chance that text of that length would
come as near to what even random draws are expected to give. The three p values are combined by weighted Stouffer scores,
so order that no random draw would show counts against a candidate as much as uneven counts do.
Benjamini-Hochberg keeps the expected share of false finds under `fdr`
within each class of encoding and length, counted over the whole table: p values are binned, the bins (a fixed
number) summed, and each class's threshold read off.

Texts are read twice, for pairs (128 x 128 numbers reach the driver) and for spans and p values. Columns: find() keeps
df's columns, text aside, in the struct `row`, so no name clashes. Overlaps are told by bisection and running ends, so a
text of a million finds takes a million steps. Cases: a null or empty text has no spans; ids may
be null or repeated, each row is scanned alone; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, let
from .pii import running

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs are maximal, so the least length can stand in the pattern.
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_RUN = 16
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: What stands between two =, with closing = where the run ends; between two /; a leading key name or path.
BETWEEN_EQUALS, BETWEEN_SLASHES = re.compile(r"[^=]+(?:=*\Z)?"), re.compile(r"[^/]+")
#: Stretches of one base64 alphabet, parted at the other's own characters.
ONE_ALPHABET = re.compile(r"[^_-]+"), re.compile(r"[^+/]+")
KEY_NAME = re.compile(r"[/_-]*(?:[A-Za-z]+[/_-]+|v[0-9]+/)+|[/_-]+")
KINDS = ("assign", "access", "hex", "random")
_ORDER = {k: i for i, k in enumerate(KINDS)}

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets from the smallest.
ENCODINGS = (
    ("hex", _DIGITS + "abcdef"),
    ("HEX", _DIGITS + "ABCDEF"),
    ("base32", _UPPER + "234567"),
    ("base36", _DIGITS + _LOWER),
    ("BASE36", _DIGITS + _UPPER),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
)
_ALPHABETS = [(name, {c: i for i, c in enumerate(letters)}, frozenset(letters)) for name, letters in ENCODINGS]
#: Expected share of false finds; p-value bins per power of ten, and powers.
FDR, BINS, POWERS = 0.05, 20, 12
#: Weights of the three tests' scores; variance of their sum for text, with the two order tests half correlated; largest score.
WEIGHTS, SUM_VARIANCE, MOST_SCORE = (2.0, 1.0, 1.0), 7.0, 7.5
#: Written text that stands in where a table has none, counted as so many pairs.
PRIOR_TEXT = "The quick report of 2024-05-17 lists version 3.10.2 of Some_Module in /usr/local/share/readme-first and https/www/index/page/12; THE HEADER OF ALL PARTS IS GIVEN IN CAPITALS, A BEAD FACED A CAFE, and the rest of the words are as plain as those in any letter that people have written to each other since 1984."
PRIOR_PAIRS = 2000.0


def pairs_in(text: str) -> np.ndarray:
    """Counts of neighbouring characters, 128 x 128; all beyond ASCII count as the character 0."""
    codes = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    codes = np.where(codes < 128, codes, 0).astype(np.int32)
    return np.bincount(codes[:-1] * 128 + codes[1:], minlength=1 << 14)


class Null:
    """What written text looks like in each alphabet, from counts of pairs."""

    def __init__(self, pairs: np.ndarray):
        prior = pairs_in(PRIOR_TEXT).astype(float)
        table = (pairs + prior * (PRIOR_PAIRS / prior.sum())).reshape(128, 128)
        self.shapes: dict[str, tuple[float, float, float, float]] = {}
        for name, letters in ENCODINGS:
            codes = [ord(c) for c in letters]
            own = table[np.ix_(codes, codes)] + 1e-3
            own /= own.sum()
            k, share = len(letters), own.sum(axis=1)
            high = np.arange(k) >= k // 2
            place = np.arange(k) - share @ np.arange(k)
            changes = own[np.ix_(high, ~high)].sum() + own[np.ix_(~high, high)].sum()
            second, third = (share**2).sum(), (share**3).sum()
            serial = place @ own @ place / (share @ place**2)
            self.shapes[name] = (k * second - 1, max(0.0, k * k * (third - second**2)), float(changes), float(serial))


def infer(run: str) -> tuple[str, dict[str, int]] | None:
    """The smallest encoding whose alphabet holds all characters (but closing =)."""
    found = set(run.rstrip("="))
    for name, places, letters in _ALPHABETS:
        if found <= letters:
            return name, places
    return None


def _below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _normal(mean: float, sd: float) -> Callable[[float], float]:
    return lambda x: _below((x - mean) / sd)


def _counts_of_text(n: int, k: int, excess: float, tail: float) -> Callable[[float], float]:
    """Distribution of chi-squared for text: a gamma distribution from the least possible value on (Wilson-Hilferty)."""
    each, more = divmod(n, k)
    least = k / n * (more * (each + 1) ** 2 + (k - more) * each**2) - n
    mean = max(1e-9, k - 1 + (n - 1) * excess - least)
    spread = (2 * (k - 1) + 4 * n * tail) / (9 * mean**2)
    return lambda x: _below((max(0.0, (x - least) / mean) ** (1 / 3) - 1 + spread) / math.sqrt(spread))


def _near(found: float, random_mean: float, of_text: Callable[[float], float], step: float) -> float:
    """Score (normal quantile of 1 - p) for the chance p that text comes as near to the random mean as what was found.
    step: what the statistic moves by at least, half of which is allowed for."""
    off = abs(found - random_mean) + step / 2
    p = min(max(of_text(random_mean + off) - of_text(random_mean - off), 1e-300), 1 - 1e-16)
    return max(-MOST_SCORE, min(MOST_SCORE, -NormalDist().inv_cdf(p)))


def statistics(x: list[int], k: int) -> tuple[float, int, float]:
    """chi-squared against even counts, runs to either side of the middle, lag-one correlation (1 for a single symbol)."""
    n, counts = len(x), {}
    for v in x:
        counts[v] = counts.get(v, 0) + 1
    chi = k / n * sum(c * c for c in counts.values()) - n
    high = [v >= k // 2 for v in x]
    mean = sum(x) / n
    spread = sum((v - mean) ** 2 for v in x)
    serial = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:], strict=False)) / spread if spread else 1.0
    return chi, 1 + sum(a != b for a, b in zip(high, high[1:], strict=False)), serial


def battery(run: str, null: Null) -> tuple[str, float] | None:
    """(class of encoding and length, p of being text); None if no encoding fits."""
    if run.isdigit():
        return None
    inferred = infer(run)
    if inferred is None:
        return None
    name, places = inferred
    x = [places[c] for c in run.rstrip("=")]
    n, k = len(x), len(places)
    if n < LEAST_RUN:
        return None
    chi, runs, correlation = statistics(x, k)
    excess, tail, changes, serial = null.shapes[name]
    even = (k // 2) * (k - k // 2) * 2 / k**2
    scores = (
        _near(chi, k - 1, _counts_of_text(n, k, excess, tail), 2 * k / n),
        _near(runs, 1 + (n - 1) * even, _normal(1 + (n - 1) * changes, math.sqrt(max(1.0, (n - 1) * changes * (1 - changes)))), 1),
        _near(correlation, -1 / n, _normal(serial - 1 / n, 1 / math.sqrt(n)), 1 / n),
    )
    p = 1 - _below(sum(w * z for w, z in zip(WEIGHTS, scores, strict=True)) / math.sqrt(SUM_VARIANCE))
    return f"{name}/{min(n.bit_length(), 12)}", p


def parts(run: str) -> list[tuple[int, int]]:
    """Start and end of the run and of its parts that are long enough, each once."""
    found = {(0, len(run)): None}
    for e in BETWEEN_EQUALS.finditer(run):
        found[e.span()] = None
        for p in BETWEEN_SLASHES.finditer(e[0]):
            found[e.start() + p.start(), e.start() + p.end()] = None
    for pattern in ONE_ALPHABET:
        for e in list(found):
            for p in pattern.finditer(run, *e):
                found[p.span()] = None
    for start, end in list(found):
        if named := KEY_NAME.match(run, start, end):
            found[named.end(), end] = None
    return [(s, e) for s, e in found if e - s >= LEAST_RUN]


def scan(text: str, null: Null) -> tuple[list[tuple], list[tuple]]:
    """(base spans, candidates): (start, order, end, kind) and (start, end, class, p) in code points, ends exclusive; candidates by
    start, of equal starts the longest first."""
    base, cands = [], []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        base += [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    base += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text)]
    base.sort()
    # a candidate overlaps a base span if one that starts before its end reaches beyond its start
    starts, reach = [s for s, _, _, _ in base], list(accumulate((e for _, _, e, _ in base), max))
    for m in RUN.finditer(text):
        for start, end in parts(m[0]):
            got = battery(m[0][start:end], null)
            start, end = m.start() + start, m.start() + end
            earlier = bisect_left(starts, end)
            if got and not (earlier and reach[earlier - 1] > start):
                cands.append((start, end, *got))
    cands.sort(key=lambda c: (c[0], -c[1]))
    return base, cands


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("ord", T.IntegerType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])
_CAND = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("cls", T.StringType()), T.StructField("p", T.DoubleType())])


def thresholds(scanned: DataFrame, fdr: float = FDR) -> dict[str, float]:
    """Class -> largest p that Benjamini-Hochberg accepts. Only bin counts, a fixed number, reach the driver."""
    p = F.greatest(F.col("c.p"), F.lit(10.0**-POWERS))
    bins = scanned.select(F.explode("cands").alias("c")).select("c.cls", F.ceil(F.log10(p) * BINS).alias("bin")).groupBy("cls", "bin").count().collect()
    found: dict[str, float] = {}
    for cls in {b.cls for b in bins}:
        own = sorted((b.bin, b["count"]) for b in bins if b.cls == cls)
        total, seen = sum(n for _, n in own), 0
        for b, n in own:
            seen += n
            if 10 ** (b / BINS) <= fdr * seen / total:
                found[cls] = 10 ** (b / BINS)
    return found


def fit_null(df: DataFrame, text_col: str = "text") -> Null:
    """Pairs of neighbouring characters of all texts, runs that may be candidates aside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 14, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += pairs_in(RUN.sub("\0", text))
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(total[codes])], ["code", "n"])

    texts = df.select(F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    pairs = np.zeros(1 << 14)
    for r in texts.mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        pairs[r.code] = r.n
    return Null(pairs)


def find(df: DataFrame, text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """`row` (df's columns without its text), `base` and `spans`: arrays of (start, ord, end, kind), ordered by start, then kind."""
    kept = [c for c in df.columns if c != text_col]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(None).cast("int").alias("none"))
    docs = df.select(row.alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([docs.schema["row"], T.StructField("base", T.ArrayType(_SPAN)), T.StructField("cands", T.ArrayType(_CAND))])
    null = fit_null(df, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        span, cand = [f.name for f in _SPAN], [f.name for f in _CAND]
        for batch in batches:
            found = [scan(t, null) if t else ((), ()) for t in batch.column(batch.num_columns - 1).to_pylist()]
            base = pa.array([[dict(zip(span, x, strict=True)) for x in b] for b, _ in found], arrow.field("base").type)
            cands = pa.array([[dict(zip(cand, x, strict=True)) for x in c] for _, c in found], arrow.field("cands").type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], base, cands], schema=arrow)

    scanned = cut(docs.mapInArrow(run, schema), "secret_candidates")
    most = thresholds(scanned, fdr)
    limit = F.create_map(*[F.lit(v) for kv in most.items() for v in kv]) if most else None
    if limit is None:
        accepted = F.filter("cands", lambda c: F.lit(False))
    else:
        accepted = F.filter("cands", lambda c: c["p"] <= F.coalesce(F.try_element_at(limit, c["cls"]), F.lit(-1.0)))
    scanned = scanned.withColumn("cands", accepted)
    # candidates are ordered so that one lies inside another if an earlier one reaches as far
    ends = running(F.transform("cands", lambda c: c["end"]), -1, F.greatest)
    outer = let(ends, lambda before: F.filter("cands", lambda c, i: F.get(before, i) < c["end"]))
    added = F.transform(outer, lambda c: F.struct(c["start"].alias("start"), F.lit(_ORDER["random"]).alias("ord"), c["end"].alias("end"), F.lit("random").alias("kind")))
    return scanned.select("row", "base", F.sort_array(F.concat("base", added)).alias("spans"))


def joined(spans: str | Column) -> Column:
    """kind:start:end of ordered spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def number_of(kind: str, spans: str | Column) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
