"""A hashed maximum-entropy language model with class-factored softmax, beside the add-half unigram base.

P(word | two words before) = P(class | context) * P(sub-class | class, context) * P(leaf | sub-class, context) *
P(word | leaf). The first three factors are softmaxes of WIDTH choices over sums of weight rows picked by hashed features:
the word before, the word before that (skip), and both, each with the choices made so far. The most frequent HEAD words
are leaves of their own in order of frequency, so their last factor is 1. All other words fall in TAIL leaves: class and
sub-class by the hash of their last letters, the leaf by the hash of the whole word; there a word has its share of
counts plus one half, and one half is left for words never seen, so the model is a distribution over all words and one
unseen word per leaf.

Training makes ROUNDS passes, each over its own part of the training documents, so every training document counts
once. In a pass each worker takes gradient steps (Adagrad, minibatches) from the common weights over about
WORKER_TOKENS tokens; the workers' changes, weighted by tokens, are averaged block by block: FAN workers' blocks are
added in one group, in order of worker, then FAN of those sums, until one is left, so no group grows with the input.
Weights are a fixed number of bytes.

Counts cover every training token: words are counted per task, then summed by word in one shuffle. Scoring keeps the
most frequent KNOWN words (a fixed number) in each worker; for the rest it writes (row, word, times), which are joined to
the counts by word, so each count is exact whatever the vocabulary's size. Words and the end of the text are tokens.

Texts are cut into words and numbered by Arrow's kernels, a group of texts at a time; Python sees each distinct word of
a group once. Features are made in windows, so a long text costs four bytes a token beside its letters.

Cases: a null or empty text is its end alone; ids may be null (they count as empty text when parts are drawn) or
repeated, each row is scored alone; without training documents all counts are 0 and weights stay 0; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

#: Choices of a softmax, softmaxes of a word; leaves; words and word groups that are leaves.
WIDTH, LEVELS = 16, 3
LEAVES = WIDTH**LEVELS
HEAD = TAIL = LEAVES // 2
KNOWN = 131_072
#: Rows of weights of a level, a power of two below 2**17; features per token; tokens in a minibatch; step; passes.
BITS, FEATURES, BATCH, STEP, ROUNDS = 16, 3, 4096, 0.25, 2
#: Training tokens per worker of a pass, about; blocks that are added in one group.
WORKER_TOKENS, FAN = 8_000_000, 16
#: Sums of weights are held within this; beyond it a softmax is flat to single precision anyway.
MOST_LOGIT = 60.0
#: Distinct words that a counting task holds at most before it hands them on.
HELD = 400_000
#: Characters of texts that are numbered together, about, and tokens whose features are made together.
GROUP_CHARS, WINDOW = 4_000_000, 16 * BATCH
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_START = np.uint64(0x51ED270B7F4A7C15)
END = b""


def numbered(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct tokens, each token's place among them, first token of each text): words with A-Z lower-cased, then the end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column))
    ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    words, codes = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy()
    try:  # the empty stretches beside outer blanks
        end = words.index(END)
        kept = codes != end
        ends = np.concatenate(([0], np.cumsum(kept)))[ends]
        codes = codes[kept]
    except ValueError:
        end = len(words)
        words.append(END)
    sizes = np.diff(ends)
    out = np.full(len(codes) + len(sizes), end, np.int32)
    out[np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)] = codes
    return words, out, ends[:-1] + np.arange(len(sizes))


def groups(column: pa.Array) -> Iterator[pa.Array]:
    """Texts in slices of about GROUP_CHARS bytes."""
    sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP_CHARS)))
        yield column.slice(at, end - at)
        at = end


def leaves_of(words: list[bytes], hashes: np.ndarray) -> np.ndarray:
    """Tail leaves from 0: the last letters choose a stretch of WIDTH leaves, the whole word one of them."""
    stems = pc.ascii_rtrim(pa.array(words, pa.binary()).cast(pa.string()), characters=".,;:!?").cast(pa.binary())
    coded = pc.binary_slice(stems, -3, 2**31 - 1).dictionary_encode()
    stretch = np.fromiter((crc32(x) % (TAIL // WIDTH) for x in coded.dictionary.to_pylist()), np.int32, len(coded.dictionary))
    return stretch[coded.indices.to_numpy()] * WIDTH + (hashes >> np.uint64(60 - 16)).astype(np.int32) % WIDTH


def hashes_of(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def count_words(df: DataFrame) -> DataFrame:
    """word (binary), leaf, n: all tokens of the column `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = list(counts)
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(leaves_of(words, hashes_of(words)), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["word", "leaf", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for texts in groups(batch.column(0)):
                words, codes, _ = numbered(texts)
                found = np.bincount(codes, minlength=len(words)).tolist()
                counts.update({w: n for w, n in zip(words, found, strict=True) if n})
                if len(counts) > HELD:
                    yield out()
        yield out()

    return df.select("text").mapInArrow(run, "word binary, leaf int, n long").groupBy("word", "leaf").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The most frequent words with counts, and the totals of leaves. Sizes are fixed by KNOWN and LEAVES."""

    def __init__(self, words: list[bytes], counts: list[int], leaf_totals: dict[int, tuple[int, int]]):
        self.words = words
        self.n_tokens = sum(t for t, _ in leaf_totals.values())
        self.n_words = sum(v for _, v in leaf_totals.values())
        self.head = min(HEAD, len(words))
        self.hashes = hashes_of(words)
        ranks, tails = np.arange(len(words)), leaves_of(words, self.hashes)
        self.leaf = np.where(ranks < self.head, ranks, HEAD + tails).astype(np.int32)
        counts = np.array(counts, np.float64)
        self.log_half = np.log10(counts + 0.5)
        totals = np.zeros(TAIL)
        for place, (n, v) in leaf_totals.items():
            totals[place] = n + 0.5 * v
        np.subtract.at(totals, tails[: self.head], counts[: self.head] + 0.5)
        self.log_leaf = np.log10(np.maximum(totals, 0) + 0.5)
        self.log_base = math.log10(self.n_tokens + 0.5 * (self.n_words + 1))
        #: For each level and prefix of choices, 1 for the choices that lead to a leaf in use, 0 for others.
        used = np.ones(LEAVES, bool)
        used[self.head : HEAD] = False
        self.exist = [used.reshape(WIDTH**k, WIDTH, -1).any(axis=2).astype(np.float32) for k in range(LEVELS)]

    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}


class Tokens:
    """The tokens of a group of texts, one after the other, as places among the group's distinct words."""

    def __init__(self, texts: pa.Array, vocabulary: Vocabulary, index: dict[bytes, int]):
        self.words, self.codes, self.starts = numbered(texts)
        self.known = np.fromiter(map(index.get, self.words, repeat(-1)), np.int64, len(self.words))
        rare = np.flatnonzero(self.known < 0)
        if len(vocabulary.words):
            self.leaf, self.hashes = vocabulary.leaf[self.known], vocabulary.hashes[self.known]
        else:
            self.leaf, self.hashes = np.zeros(len(self.words), np.int32), np.zeros(len(self.words), np.uint64)
        if len(rare):
            words = [self.words[i] for i in rare.tolist()]
            self.hashes[rare] = hashes_of(words)
            self.leaf[rare] = HEAD + leaves_of(words, self.hashes[rare])
        self.first = np.zeros(len(self.codes), bool)
        self.first[self.starts] = True

    def _context(self, a: int, z: int) -> np.ndarray:
        """Hashes of the features of tokens a to z."""
        lo = max(0, a - 2)
        h, first = self.hashes[self.codes[lo:z]], self.first[lo:z]
        one = np.concatenate(([_START], h[:-1]))
        one[first] = _START
        two = np.concatenate(([_START], one[:-1]))
        two[first] = _START
        one, two = one[a - lo :], two[a - lo :]
        x = np.stack([one * np.uint64(3), two * np.uint64(0xC2B2AE3D27D4EB4F), one * np.uint64(0x165667B19E3779F9) + two])
        return (x ^ (x >> np.uint64(29))) * _GOLD

    def batches(self) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(level, tokens, feature rows, prefixes, choices), BATCH tokens at a time. Levels have weights of their own, so a
        window's tokens go through one level after the other, whose table then stays in the processor's cache."""
        for a in range(0, len(self.codes), WINDOW):
            z = min(a + WINDOW, len(self.codes))
            context, leaves = self._context(a, z), self.leaf[self.codes[a:z]]
            for k in range(LEVELS):
                path = leaves // WIDTH ** (LEVELS - k - 1)
                prefix = path // WIDTH
                rows = (((context ^ (prefix.astype(np.uint64) << np.uint64(8))) * _GOLD) >> np.uint64(64 - BITS)).astype(np.uint16)
                prefix, choice = prefix.astype(np.uint16), path % WIDTH
                for i in range(0, z - a, BATCH):
                    j = min(i + BATCH, z - a)
                    yield k, slice(a + i, a + j), rows[:, i:j], prefix[i:j], choice[i:j]


class Model:
    """Weights: for each level the feature rows, and a bias row for each prefix of choices."""

    SHAPES = tuple(shape for k in range(LEVELS) for shape in ((1 << BITS, WIDTH), (WIDTH**k, WIDTH)))

    def __init__(self, flat: np.ndarray | None = None):
        flat = np.zeros(sum(a * b for a, b in self.SHAPES), np.float32) if flat is None else flat
        self.flat, self.parts, at = flat, [], 0
        for a, b in self.SHAPES:
            self.parts.append(flat[at : at + a * b].reshape(a, b))
            at += a * b

    def powers(self, level: int, rows: np.ndarray, prefix: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """exp of the summed weights, 0 for choices without a leaf in use, and the sum of each row."""
        w = self.parts[2 * level]
        x = w.take(rows[0], axis=0)
        for r in rows[1:]:
            x += w.take(r, axis=0)
        x += self.parts[2 * level + 1].take(prefix, axis=0)
        np.clip(x, -MOST_LOGIT, MOST_LOGIT, out=x)
        np.exp(x, out=x)
        if v.head < HEAD:
            x *= v.exist[level].take(prefix, axis=0)
        return x, x @ np.ones(WIDTH, np.float32)

    def logs(self, t: Tokens, v: Vocabulary) -> np.ndarray:
        """Natural log of P(leaf | context) for each token."""
        out = np.zeros(len(t.codes))
        for k, at, rows, prefix, choice in t.batches():
            x, total = self.powers(k, rows, prefix, v)
            out[at] += np.log(x[np.arange(len(x)), choice]) - np.log(total)
        return out


class Trainer:
    """Adagrad steps from given weights, one step size per weight row."""

    def __init__(self, model: Model):
        self.model = Model(model.flat.copy())
        self.squares = [np.full(len(p), 1e-2, np.float32) for p in self.model.parts]
        self.tokens = 0

    def _apply(self, part: int, rows: np.ndarray, total: np.ndarray) -> None:
        """A step on distinct rows from their summed gradients."""
        squares = self.squares[part][rows] + np.einsum("ij,ij->i", total, total) / total.shape[1]
        self.squares[part][rows] = squares
        total *= (-STEP / np.sqrt(squares))[:, None]
        weights = self.model.parts[part]
        total += weights.take(rows, axis=0)
        weights[rows] = total

    def _step(self, part: int, rows: np.ndarray, grads: np.ndarray) -> None:
        """Sum the gradients of equal rows over all features and take the step."""
        rows = rows.ravel()
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        order %= len(grads)
        total, size = grads.take(order[first], axis=0), np.diff(first, append=len(rows))
        several = size > 1  # most rows occur once, and reduceat costs by the run
        if several.any():
            own = order[np.repeat(several, size)]
            total[several] = np.add.reduceat(grads.take(own, axis=0), np.cumsum(size[several]) - size[several], axis=0)
        self._apply(part, rows[first], total)

    def learn(self, t: Tokens, v: Vocabulary) -> None:
        self.tokens += len(t.codes)
        for k, _, rows, prefix, choice in t.batches():
            g, total = self.model.powers(k, rows, prefix, v)
            g /= total[:, None]
            g[np.arange(len(g)), choice] -= 1
            self._step(2 * k, rows, g)
            self._step(2 * k + 1, prefix, g)


BLOCK = 1 << 17


def _sum_blocks(table: pa.Table) -> pa.Table:
    """The weighted sum of a group's changes, in order of worker."""
    total, tokens = None, 0
    for place in np.argsort(table.column("worker").to_numpy(), kind="stable").tolist():
        x = np.frombuffer(table.column("change")[place].as_buffer(), np.float32)
        total = x.copy() if total is None else total + x
        tokens += table.column("tokens")[place].as_py()
    return pa.table({"block": table.column("block")[:1].cast(pa.int32()), "worker": pa.array([table.column("worker")[0].as_py() // FAN], pa.int32()), "tokens": pa.array([tokens], pa.int64()), "change": pa.array([total.tobytes()], pa.binary())})


def train(df: DataFrame, vocabulary, model: Model, workers: int) -> Model:
    """One pass over the column `text`: the average of what the workers make of the weights."""
    weights = df.sparkSession.sparkContext.broadcast(model.flat)
    schema = "block int, worker int, tokens long, change binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v = vocabulary.value
        index, trainer = v.index(), Trainer(Model(weights.value))
        for batch in batches:
            for texts in groups(batch.column(0)):
                trainer.learn(Tokens(texts, v, index), v)
        if trainer.tokens:
            change = (trainer.model.flat - weights.value) * np.float32(trainer.tokens)
            n = -(-len(change) // BLOCK)
            values = [range(n), [TaskContext.get().partitionId()] * n, [trainer.tokens] * n, [change[i * BLOCK : (i + 1) * BLOCK].tobytes() for i in range(n)]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["block", "worker", "tokens", "change"])

    changes = df.select("text").coalesce(workers).mapInArrow(run, schema)
    left = workers
    while left > 1:
        changes = changes.groupBy("block", F.expr(f"worker div {FAN}").alias("team")).applyInArrow(lambda _, table: _sum_blocks(table), schema)
        left = -(-left // FAN)
    blocks = {r.block: np.frombuffer(r.change, np.float32) / np.float32(r.tokens) for r in changes.toLocalIterator()}
    weights.destroy()
    flat = model.flat.copy()
    if blocks:
        flat += np.concatenate([blocks[i] for i in sorted(blocks)])
    return Model(flat)


def fit(df: DataFrame, counts: DataFrame, rounds: int = ROUNDS):
    """(broadcast Vocabulary, broadcast weights) from training documents (column text) and their counted words."""
    spark = df.sparkSession
    top = counts.orderBy(F.desc("n"), "word").limit(KNOWN).select("word", "n").toArrow()
    totals = {r.leaf: (r.n, r.v) for r in counts.groupBy("leaf").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    vocabulary = spark.sparkContext.broadcast(Vocabulary(top.column(0).to_pylist(), top.column(1).to_pylist(), totals))
    model = Model()
    workers = max(1, -(-vocabulary.value.n_tokens // (WORKER_TOKENS * rounds)))
    for k in range(rounds):
        part = F.pmod(F.xxhash64("text"), F.lit(rounds)) == k
        model = train(df.where(part), vocabulary, model, workers)
    return vocabulary, spark.sparkContext.broadcast(model.flat)


def score(df: DataFrame, held_out, text_col: str = "text", id_col: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """The id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row.

    held_out: a condition on df's columns; rows for which it is not true are learned from.
    """
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text_of(f"`{text_col}`").alias("text"))
    training = docs.where(~F.col("held_out")).select("text")
    counts = cut(count_words(training), "word_counts")
    vocabulary, weights = fit(training, counts, rounds)
    n_tokens, log_base = vocabulary.value.n_tokens, vocabulary.value.log_base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, model = vocabulary.value, Model(weights.value)
        index = v.index()
        for batch in batches:
            at = 0
            for texts in groups(batch.column(1)):
                t = Tokens(texts, v, index)
                logs = model.logs(t, v) / math.log(10)
                # what a distinct word adds to its tokens' sums
                is_known = t.known >= 0
                half, share = np.zeros(len(t.words)), np.zeros(len(t.words))
                if len(v.words):
                    half[is_known] = v.log_half[t.known[is_known]]
                in_tail = t.leaf >= HEAD
                share[in_tail] = half[in_tail] - v.log_leaf[t.leaf[in_tail] - HEAD]
                logs += share[t.codes]
                seen = is_known[t.codes]
                sums = [np.diff(t.starts, append=len(logs)), *(np.add.reduceat(x, t.starts) for x in (seen.astype(np.int64), half[t.codes], logs))]
                rare = np.flatnonzero(~seen)
                row = np.searchsorted(t.starts, rare, side="right") - 1
                pairs, times = np.unique(row * len(t.words) + t.codes[rare], return_counts=True)
                sizes = np.searchsorted(pairs, np.arange(len(texts) + 1) * len(t.words))
                words = [t.words[i] for i in (pairs % len(t.words)).tolist()]
                held = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int64())], ["word", "n"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2]), pa.array(sums[3]), held], ["row", "n_tokens", "n_seen", "halves", "logs", "rare"])
                at += len(texts)

    schema = "row struct<id:{},held_out:boolean>, n_tokens long, n_seen long, halves double, logs double, rare array<struct<word:binary,n:bigint>>".format(df.schema[id_col].dataType.simpleString())
    scored = docs.select(F.struct("id", "held_out").alias("row"), "text").mapInArrow(run, schema)
    scored = cut(scored.withColumn("rid", F.monotonically_increasing_id()), "scored")
    vocabulary.destroy()
    weights.destroy()
    words = scored.select("rid", F.explode("rare").alias("r")).select("rid", F.col("r.word").alias("word"), F.col("r.n").alias("times"))
    found = words.join(counts.select("word", F.col("n").alias("c")), "word", "left")
    sums = found.groupBy("rid").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_halves"))
    joined = scored.drop("rare").join(sums, "rid", "left").na.fill({"more": 0, "rare_halves": 0.0})
    return joined.select(
        F.col("row.id").alias(id_col),
        "row.held_out",
        "n_tokens",
        (F.col("n_seen") + F.col("more")).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("halves") + F.col("rare_halves") - F.col("n_tokens") * log_base).alias("base_score"),
        (F.col("logs") + F.col("rare_halves")).alias("score"),
    )
