"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes FEATURES numbers: shares of kinds of bytes, entropy, how far it compresses, and what its words and lines look
like. Texts are read whole, PART characters at a time, and a feature is a ratio of sums over the parts, so a text's length
does not matter for memory.

The model adds one lookup table per feature and one per chosen pair of features. Tables are learned by cyclic boosting:
round after round each feature in turn gets a tree of at most three leaves, fitted to the logistic loss' gradients in the
feature's bins, a RATE part of which is added to its table; rounds end when the loss on one row in VALID no longer falls. Then
the pairs are ranked by what a table over both features' coarse bins would still gain, and the best PAIRS are boosted the same
way with trees of at most four leaves over two features. Scoring looks up bins and adds, whole Arrow batches at a time.

Features are worked out once and written in the shared folder: a few bytes per document. Learning takes the labelled rows
among them, equal rows counted once with their number as weight; at most SAMPLE labels take part, chosen by a hash of the id,
and at most SAMPLE different rows, chosen by a hash of the row. That is all that reaches the driver and all that is bounded:
every row of the table is scored. Memory on the driver is SAMPLE times FEATURES numbers, some 20 MB.

Cases: a null text is empty, and empty texts get the score that their features (all zero) have; null labels, and labels of ids
that no document has, teach nothing; if an id has several labels the larger share decides, ties for 1; with no labelled row, or
only one label among them, all scores are that label's share (0.5 for none); ids may be null (never labelled) or repeated; an
empty table gives an empty result. Columns other than id and text are kept in the struct `row`, so no name clashes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: Labels, and different labelled rows, that learning takes at most.
SAMPLE = 100_000
#: Bins of a feature; coarse bins of a feature in a pair; pairs; rounds; part of a tree that is added; weight that holds leaves back.
BINS, COARSE, PAIRS, ROUNDS, RATE, RIDGE = 32, 8, 10, 200, 0.1, 1.0
#: One training row in so many tells when to stop; rounds without progress until then.
VALID, PATIENCE = 8, 10
PART = 1 << 20

#: Kinds of bytes whose shares are features.
_KINDS = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".!?", b",;:", b"#*$%&|<>", b"'\"()[]{}", b"~^=+_@\\/-`",
    bytes(range(128, 256)), bytes(b for b in range(32) if b not in b"\t\n\x0b\x0c\r"),
)
_KIND = np.zeros((256, len(_KINDS)))
for _k, _bytes in enumerate(_KINDS):
    _KIND[list(_bytes), _k] = 1
_ENDS, _BULLETS = (".", "!", "?", ":", "…", '"'), ("-", "*", "•", "·")
#: Sums over a text: bytes and kinds of bytes, entropy and compressed bytes, seven sums and four counts of words, five of lines.
_SUMS = 1 + len(_KINDS) + 2 + 7 + 4 + 5
FEATURES = len(_KINDS) + 20


def _parts(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = at + PART
        if end < len(text):
            gap = text.rfind("\n", at + PART // 2, end)
            gap = gap if gap >= 0 else text.rfind(" ", at, end)
            end = gap + 1 if gap > at else end
        yield text[at:end]
        at = end


def _sums(text: str) -> np.ndarray:
    """What one part adds to the sums that features() makes ratios of."""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts[counts > 0] / len(raw)
    words = text.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    of_lines = np.fromiter(map(len, lines), np.int64, len(lines))
    return np.concatenate((
        [len(raw)], counts @ _KIND, [-(share * np.log2(share)).sum() * len(raw), len(zlib.compress(raw, 1))],
        [n, lengths.sum(), (lengths > 15).sum(), (lengths == 1).sum(), len(seen), max(seen.values(), default=0), len(set(zip(words, words[1:], strict=False)))],
        [sum(map(eq, words, words[1:])), sum(map(str.istitle, words)), sum(map(str.isupper, words)), sum(map(str.isalpha, words))],
        [len(lines), len(set(lines)), (of_lines < 30).sum(), sum(x.endswith(_ENDS) for x in lines), sum(x.startswith(_BULLETS) for x in lines)],
    )).astype(float)


def features(text: str) -> np.ndarray:
    """The text's FEATURES numbers."""
    s = sum((_sums(part) for part in _parts(text)), np.zeros(_SUMS))
    size, kinds, rest = s[0], s[1 : 1 + len(_KINDS)], s[1 + len(_KINDS) :]
    entropy, packed, n, letters, long, single, distinct, top, pairs, same, title, upper, alpha, lines, unlike, short, ended, bullets = rest
    words, stops = max(n, 1), max(kinds[5], 1)
    return np.concatenate((
        [np.log1p(size)], kinds / max(size, 1), [entropy / max(size, 1), packed / max(size, 1), np.log1p(n), letters / words, long / words, single / words, distinct / words, top / words],
        [pairs / words, same / words, title / words, upper / words, alpha / words, unlike / max(lines, 1), short / max(lines, 1), ended / max(lines, 1), bullets / max(lines, 1), n / max(lines, 1), n / stops],
    )).astype(np.float32)


def described(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`row` (docs' columns without the text) and `x`, its features; written in the shared folder."""
    kept = [c for c in docs.columns if c != text_col]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(None).cast("int").alias("none"))
    texts = docs.select(row.alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([texts.schema["row"], T.StructField("x", T.ArrayType(T.FloatType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(1)]
            flat = np.concatenate(found) if found else np.zeros(0, np.float32)
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * FEATURES), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], ["row", "x"])

    return cut(texts.mapInArrow(run, schema), "features")


class Gam:
    """Lookup tables: `tables` a row of BINS per feature, `pairs` (feature, feature, COARSE x COARSE)."""

    def __init__(self, edges: list[np.ndarray], base: float):
        self.edges, self.base = edges, base
        self.tables = np.zeros((len(edges), BINS))
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def binned(self, x: np.ndarray) -> np.ndarray:
        """The bin of each number."""
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1).astype(np.uint8) if len(self.edges) else np.zeros((len(x), 0), np.uint8)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        """Sum of the tables' entries."""
        out = np.full(len(bins), self.base)
        for f in range(bins.shape[1]):
            out += self.tables[f][bins[:, f]]
        for f, g, table in self.pairs:
            out += table[_coarse(bins[:, f]), _coarse(bins[:, g])]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(self.binned(x)), -30, 30)))


def _coarse(bins: np.ndarray) -> np.ndarray:
    return bins // (BINS // COARSE)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins into two leaves."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(a):
        return 0.0, 0
    gain = a**2 / (b + RIDGE) + (g.sum() - a) ** 2 / (h.sum() - b + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def line_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of at most three leaves over bins: each bin's value."""
    cuts = [0, len(g)]
    for _ in range(2):
        found = [(*_best_cut(g[a:b], h[a:b]), a) for a, b in zip(cuts, cuts[1:], strict=False)]
        gain, at, a = max(found)
        if gain <= 0:
            break
        cuts = sorted({*cuts, a + at})
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _axis_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
    """Gain, axis and place of the best cut of a rectangle of bins."""
    return max((*_best_cut(g.sum(1 - axis), h.sum(1 - axis)), axis) for axis in (0, 1))


def plane_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of at most four leaves over two features' bins: each cell's value."""
    out = np.zeros(g.shape)

    def grow(rows: slice, cols: slice, depth: int) -> None:
        gain, at, axis = _axis_cut(g[rows, cols], h[rows, cols])
        if depth == 0 or gain <= 0 or at == 0:
            out[rows, cols] = -g[rows, cols].sum() / (h[rows, cols].sum() + RIDGE)
        elif axis == 0:
            grow(slice(rows.start, rows.start + at), cols, depth - 1)
            grow(slice(rows.start + at, rows.stop), cols, depth - 1)
        else:
            grow(rows, slice(cols.start, cols.start + at), depth - 1)
            grow(rows, slice(cols.start + at, cols.stop), depth - 1)

    grow(slice(0, g.shape[0]), slice(0, g.shape[1]), 2)
    return out


def _loss(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    return float((w * np.logaddexp(0, np.where(y > 0, -margin, margin))).sum())


def _steps(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margin))
    return w * (p - y), w * p * (1 - p)


def train(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> Gam:
    """The model of these rows; y is 0 or 1, w how often a row stands for itself."""
    total, ones = float(w.sum()), float((w * y).sum())
    share = np.clip(ones / total if total else 0.5, 1e-3, 1 - 1e-3)
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)).astype(np.float32) for f in range(x.shape[1])] if len(x) else []
    model = Gam(edges, float(np.log(share / (1 - share))))
    if not 0 < ones < total:
        return model
    bins = model.binned(x)
    # one row in VALID, spread evenly, tells when to stop
    held = np.arange(len(y)) % VALID == VALID - 1
    fit = ~held if held.any() and 0 < (w * y)[~held].sum() < w[~held].sum() else np.ones(len(y), bool)

    def boost(places: list[np.ndarray], sizes: list[int], tree, shape, tables: list[np.ndarray]) -> None:
        """Cyclic boosting of tables over cell numbers; tables are set to those of the best round."""
        margin = model.margins(bins)
        best, found, since = _loss(margin[held], y[held], w[held]) if held.any() else np.inf, [t.copy() for t in tables], 0
        for _ in range(rounds):
            for place, size, table in zip(places, sizes, tables, strict=True):
                g, h = _steps(margin[fit], y[fit], w[fit])
                step = RATE * tree(np.bincount(place[fit], g, size).reshape(shape), np.bincount(place[fit], h, size).reshape(shape))
                table += step
                margin += step.reshape(-1)[place]
            now = _loss(margin[held], y[held], w[held]) if held.any() else _loss(margin, y, w)
            if now < best - 1e-6 * total:
                best, found, since = now, [t.copy() for t in tables], 0
            else:
                since += 1
                if since >= PATIENCE:
                    break
        for table, kept in zip(tables, found, strict=True):
            table[...] = kept

    n = bins.shape[1]
    boost([bins[:, f].astype(np.int64) for f in range(n)], [BINS] * n, line_tree, (BINS,), [model.tables[f] for f in range(n)])

    # pairs by what cells of both would still gain beyond one tree on them
    g, h = _steps(model.margins(bins)[fit], y[fit], w[fit])
    coarse = _coarse(bins).astype(np.int64)
    gains = []
    for a in range(n):
        for b in range(a + 1, n):
            place = coarse[fit, a] * COARSE + coarse[fit, b]
            of_g, of_h = np.bincount(place, g, COARSE**2), np.bincount(place, h, COARSE**2)
            gains.append((float((of_g**2 / (of_h + RIDGE)).sum()), a, b))
    chosen = sorted(gains, key=lambda t: (-t[0], t[1:]))[:pairs]
    tables = [np.zeros((COARSE, COARSE)) for _ in chosen]
    places = [coarse[:, a] * COARSE + coarse[:, b] for _, a, b in chosen]
    boost(places, [COARSE**2] * len(chosen), plane_tree, (COARSE, COARSE), tables)
    model.pairs = [(a, b, t) for (_, a, b), t in zip(chosen, tables, strict=True)]
    return model


def learn(found: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "label", sample: int = SAMPLE) -> Gam:
    """The model of described() rows whose id the labels (id_col, label_col 0 or 1) know."""
    label = F.col(f"`{label_col}`").cast("int")
    known = labels.where(label.isin(0, 1) & F.col(f"`{id_col}`").isNotNull())
    total = known.count()
    if total > sample:  # whole ids, so that an id's labels stay together
        known = known.where(F.pmod(F.xxhash64(f"`{id_col}`", F.lit(1)), F.lit(1 << 30)) < int((1 << 30) * sample / total))
    known = known.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.when(F.avg(label) >= 0.5, 1).otherwise(0).alias("y"))
    rows = found.join(F.broadcast(known), F.col(f"row.`{id_col}`") == F.col("id")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    rows = cut(rows, "labelled")
    different = rows.count()
    key = F.xxhash64("x", "y")
    if different > sample:
        rows = rows.where(F.pmod(key, F.lit(1 << 30)) < int((1 << 30) * sample / different))
    table = rows.orderBy(key).toArrow()
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES) if len(table) else np.zeros((0, FEATURES), np.float32)
    return train(x, table.column("y").to_numpy().astype(float), table.column("w").to_numpy().astype(float))


def score(found: DataFrame, model: Gam) -> DataFrame:
    """`row` and `score` (the chance of label 1) of described() rows."""
    shared = found.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(x), pa.float64())], ["row", "score"])

    schema = T.StructType([found.schema["row"], T.StructField("score", T.DoubleType())])
    return found.mapInArrow(run, schema)
