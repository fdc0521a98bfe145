"""Prefix trie of conversations, in succinct level order per prefix shard.

A turn's label is the MD5 of its role and text, a conversation's sequence the string of its labels (16 bytes a turn). Equal
sequences are one row with their number and least id, so copies meet in counts before anything else happens. Sequences are parted
into shards by a prefix: of the depths 0, 1, 2, 4, 8, ... the first below whose prefix lie at most SHARD turns, or one
sequence. Each shard is a trie of its own: numpy takes the sorted sequences, finds how far each shares its predecessor's
path, and lays the nodes out in level order as a LOUDS bit string (a 1 per child, then a 0, node by node) with an array of
labels. Parents are read from the bits; members, least ids, leaves and saved code points go up level by level, deepest first,
with add.at and minimum.at. The levels above the shards, through which much of the table may pass, are merged apart: each shard
sends one row (its root's sums and path), and Spark adds these up by prefix and by prefix of prefixes.

The ids that end in one node are hashed as a stream: sorted by sequence and id over range partitions, joined to pieces of at
most PIECE characters there, and the pieces of a sequence hashed in order. SHA-256 is sequential, so a sequence's pieces (not
its rows) pass through one task, a piece at a time.

One task holds at a time: a conversation's labels (20 bytes a turn, never its texts), a piece of ids, or CHUNK turns of shards.

Cases: rows without an id take no part; null roles and texts are empty; a null turn comes first, equal turns in order of their
label; repeated rows are turns of their own; a conversation whose turns are all replaced may have none and ends in the root;
an empty table has no nodes; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

#: Turns of a shard; turns a task lays out together; characters of a piece of ids.
SHARD, CHUNK, PIECE = 1 << 12, 1 << 18, 1 << 16
#: Rows of a table that is broadcast (its rows have bounded size); copies of its rows otherwise.
FEW, SALT = 50_000, 16
LABEL = 16
_NONE = hashlib.sha256(b"").hexdigest()


# ---- one shard's trie -------------------------------------------------------------------------------------------------


class Louds:
    """A forest in level order: `bits` has a 1 for each root and a 0, then for each node a 1 per child and a 0."""

    def __init__(self, degrees: np.ndarray, roots: int):
        of = np.concatenate(([roots], degrees))
        self.size = len(degrees)
        ends = np.cumsum(of + 1) - 1
        plain = np.ones(self.size + len(of), np.uint8)
        plain[ends] = 0
        self.length, self.bits = len(plain), np.packbits(plain)

    def parents(self) -> np.ndarray:
        """Each node's parent, -1 for roots: the zeros before the node's own 1, less that of the roots."""
        ones = np.flatnonzero(np.unpackbits(self.bits, count=self.length))
        return ones - np.arange(self.size) - 1

    def degrees(self) -> np.ndarray:
        """Each node's number of children: the ones between the zeros."""
        zeros = np.flatnonzero(np.unpackbits(self.bits, count=self.length) == 0)
        return np.diff(zeros) - 1


def shared(labels: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many labels each sequence (from starts, lengths long) shares with the one before it; 0 for the first."""
    out = np.zeros(len(starts), np.int64)
    if len(starts) < 2:
        return out
    n = np.minimum(lengths[1:], lengths[:-1])
    upto = np.cumsum(n)
    within = np.arange(upto[-1] if len(n) else 0) - np.repeat(upto - n, n)
    same = (labels[np.repeat(starts[1:], n) + within] == labels[np.repeat(starts[:-1], n) + within]).all(axis=1)
    first = np.where(same, np.iinfo(np.int64).max, within)
    some = np.flatnonzero(n)
    if len(some):
        out[1:][some] = np.minimum(np.minimum.reduceat(first, (upto - n)[some]), n[some])
    return out


class Forest:
    """Tries of consecutive shards. `shard` numbers each sequence's shard, `labels` (n x LABEL bytes) and `chars` hold all
    sequences' labels and code points below the shard's root one after the other, `own` the code points of the root's turn."""

    def __init__(self, shard: np.ndarray, lengths: np.ndarray, labels: np.ndarray, chars: np.ndarray, own: np.ndarray, members: np.ndarray, least: np.ndarray):
        rows = len(lengths)
        starts = np.cumsum(lengths) - lengths
        common = shared(labels, starts, lengths)
        new = np.concatenate(([True], shard[1:] != shard[:-1]))
        common[new] = -1
        n = lengths - common
        row = np.repeat(np.arange(rows), n)
        depth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(common + 1, n)
        key = depth * rows + row
        order = np.argsort(key, kind="stable")
        self.row, self.depth, key = row[order], depth[order], key[order]
        above = np.searchsorted(key, key - rows, side="right") - 1
        below = self.depth > 0
        self.louds = Louds(np.bincount(above[below], minlength=len(key)), int((~below).sum()))
        place = starts[self.row] + self.depth - 1
        if len(labels):
            self.labels = np.where(below[:, None], labels[np.maximum(place, 0)], 0)
            self.chars = np.where(below, chars[np.maximum(place, 0)], own[self.row])
        else:
            self.labels, self.chars = np.zeros((len(key), LABEL), np.uint8), own[self.row]
        self.ends = np.searchsorted(key, lengths * rows + np.arange(rows))
        self._roll(members, least)

    def _roll(self, members: np.ndarray, least: np.ndarray) -> None:
        """Sums over members and subtrees, in reverse level order."""
        size = self.louds.size
        self.parents, self.degrees = self.louds.parents(), self.louds.degrees()
        self.members, self.saved = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.least = np.full(size, np.iinfo(np.int64).max)
        self.leaves = (self.degrees == 0).astype(np.int64)
        np.add.at(self.members, self.ends, members)
        np.minimum.at(self.least, self.ends, least)
        levels = np.searchsorted(self.depth, np.arange(self.depth[-1] + 2)) if size else np.zeros(1, np.int64)
        for a, b in zip(levels[-2::-1], levels[:0:-1], strict=True):
            self.saved[a:b] += (self.members[a:b] - 1) * self.chars[a:b]
            up = self.parents[a:b]
            if up[0] >= 0:
                np.add.at(self.members, up, self.members[a:b])
                np.add.at(self.leaves, up, self.leaves[a:b])
                np.add.at(self.saved, up, self.saved[a:b])
                np.minimum.at(self.least, up, self.least[a:b])


# ---- sequences --------------------------------------------------------------------------------------------------------


def sequences(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, labels (binary) and chars (array) of each conversation, in order of its turns."""
    role, text = text_of(f"`{role_col}`"), text_of(f"`{text_col}`")
    label = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = df.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("conv"), F.struct(F.col(f"`{turn_col}`").isNotNull().alias("known"), F.col(f"`{turn_col}`").alias("turn"), label.alias("label"), F.length(text).alias("chars")).alias("t"))
    own = turns.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return own.select("conv", F.unhex(F.array_join(F.transform("t", lambda t: t["label"]), "")).alias("labels"), F.transform("t", lambda t: t["chars"]).alias("chars"))


def branched(own: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % every in place of its own first h, h being
    crc32 of c in decimal, modulo heads."""
    base = own.where(F.col("conv") % every == 0).select(
        F.col("conv").alias("base"), F.substring("labels", 1, LABEL * (heads - 1)).alias("head"), F.slice("chars", 1, heads - 1).alias("head_chars")
    )
    rows = own.withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("int")).withColumn("base", F.col("conv") - F.col("conv") % every)
    rows = rows.join(base, "base", "left")
    labels = F.concat(F.coalesce(F.expr(f"substring(head, 1, {LABEL} * h)"), F.lit(b"")), F.expr(f"substring(labels, {LABEL} * h + 1)"))
    chars = F.concat(F.coalesce(F.slice("head_chars", F.lit(1), F.col("h")), F.array().cast("array<int>")), F.expr("slice(chars, h + 1, size(chars))"))
    return rows.select("conv", labels.alias("labels"), chars.alias("chars"))


def hashed_ids(rows: DataFrame) -> DataFrame:
    """key and ends: SHA-256 of the decimal `conv`s of each `key`, ascending and joined by commas."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, 0, [], 0
        for batch in batches:
            out: list[tuple] = []
            for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key or size > PIECE:
                    if ids:
                        out.append((key, first, ",".join(ids)))
                    key, first, ids, size = k, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], ["key", "first", "piece"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([first], pa.int64()), pa.array([",".join(ids)])], ["key", "first", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, ends = [], []
            for k, piece in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if k != key:
                    if state is not None:
                        keys.append(key)
                        ends.append(state.digest())
                    key, state = k, hashlib.sha256(piece.as_buffer())
                else:
                    state.update(b",")
                    state.update(piece.as_buffer())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ends, pa.binary())], ["key", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.digest()], pa.binary())], ["key", "ends"])

    pieces = rows.select("key", "conv").repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(joined, "key string, first long, piece string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key string, ends binary")


# ---- shards and the levels above ----------------------------------------------------------------------------------------


def _prefix(col: str, depth: Column | str) -> Column:
    return F.expr(f"substring({col}, 1, {LABEL} * ({depth}))")


def _looked_up(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """rows with the table's columns (left join). A key may be on most rows: a small table is broadcast, each key of a larger one
    stands on SALT keys."""
    if table.limit(FEW + 1).count() <= FEW:
        return rows.join(F.broadcast(table), on, "left")
    salted = table.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALT)))))
    return rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int")).join(salted, [on, "salt"], "left").drop("salt")


def sharded(seqs: DataFrame, limit: int) -> DataFrame:
    """seqs with `cut_at`: the depth whose prefix names the shard, null for sequences that end above the shards."""
    turns = F.size("chars")
    total = seqs.agg(F.sum(turns + 1).alias("turns"), F.count(F.lit(1)).alias("n"), F.max(turns).alias("deepest")).first()
    if (total.turns or 0) <= limit or total.n <= 1:
        return seqs.withColumn("cut_at", F.lit(0))
    depths = [1 << k for k in range(max(1, int(total.deepest)).bit_length())]
    places = seqs.select("key", turns.alias("turns"), "labels", F.explode(F.array(*map(F.lit, depths))).alias("depth")).where("depth <= turns")
    places = places.select("key", "turns", "depth", F.md5(_prefix("labels", "depth")).alias("prefix"))
    heavy = places.groupBy("prefix").agg(F.sum(F.col("turns") + 1).alias("turns"), F.count(F.lit(1)).alias("n")).where(f"turns > {limit} and n > 1")
    heavy = cut(heavy.select("prefix", F.lit(True).alias("heavy")), "heavy_prefixes")
    light = _looked_up(places, heavy, "prefix").where("heavy is null").groupBy("key").agg(F.min("depth").alias("cut_at"))
    return seqs.join(light, "key", "left")


_NODE = "conv long, depth long, parent_conv long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, path binary, path_chars array<int>"


def shard_nodes(seqs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The nodes of all shards; a shard's root has the path (labels and code points of its turns) that leads to it."""

    def laid_out(rows: list[tuple]) -> pa.RecordBatch:
        names, at, labels, chars, members, least, ends = zip(*rows, strict=True)
        at = np.array(at, np.int64)
        lengths = np.array([len(c) for c in chars], np.int64) - at
        number = np.cumsum([a != b for a, b in zip(names, (None, *names), strict=False)])
        below = np.frombuffer(b"".join(x[LABEL * a :] for x, a in zip(labels, at.tolist(), strict=True)), np.uint8).reshape(-1, LABEL)
        below_chars = np.concatenate([c[a:] for c, a in zip(chars, at.tolist(), strict=True)]).astype(np.int64)
        own = np.array([c[a - 1] if a else 0 for c, a in zip(chars, at.tolist(), strict=True)], np.int64)
        f = Forest(number, lengths, below, below_chars, own, np.array(members, np.int64), np.array(least, np.int64))
        size = f.louds.size
        up = f.parents
        ended = np.full(size, -1)
        ended[f.ends] = np.arange(len(rows))
        roots = [(labels[r][: LABEL * a], chars[r][:a]) for r, a in zip(f.row[up < 0].tolist(), at[f.row[up < 0]].tolist(), strict=True)]
        rest = [None] * (size - len(roots))
        columns = [
            pa.array(f.least), pa.array(f.depth + at[f.row]), pa.array(f.least[np.maximum(up, 0)], pa.int64(), mask=up < 0), pa.array(f.members), pa.array(f.degrees), pa.array(f.leaves), pa.array(f.saved),
            pa.array([ends[r] if r >= 0 else None for r in ended.tolist()], pa.binary()), pa.array([p for p, _ in roots] + rest, pa.binary()), pa.array([c for _, c in roots] + rest, pa.list_(pa.int32())),
        ]
        return pa.RecordBatch.from_arrays([c.cast(pa.int64()) if i < 7 else c for i, c in enumerate(columns)], [x.split()[0] for x in _NODE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns = [], 0
        for batch in batches:
            chars = batch.column(3)
            flat, offsets = chars.flatten().to_numpy(zero_copy_only=False), chars.offsets.to_numpy() - chars.offsets[0].as_py()
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6)]
            for i, (name, at, labels, members, least, ends) in enumerate(zip(*columns, strict=True)):
                if turns > chunk and name != held[-1][0]:
                    yield laid_out(held)
                    held, turns = [], 0
                held.append((name, at, labels, flat[offsets[i] : offsets[i + 1]], members, least, ends))
                turns += int(offsets[i + 1] - offsets[i]) + 1
        if held:
            yield laid_out(held)

    rows = seqs.where("cut_at is not null").select(F.md5(F.concat(F.col("cut_at").cast("string").cast("binary"), _prefix("labels", "cut_at"))).alias("shard"), "cut_at", "labels", "chars", "n", "conv", "ends")
    return rows.repartition("shard").sortWithinPartitions("shard", "labels").mapInArrow(run, _NODE)


def upper_nodes(roots: DataFrame, ended: DataFrame) -> DataFrame:
    """The nodes above the shards' roots: `pre` (their labels), depth, conv, n_convs, n_children, n_leaves, saved_tokens, ends."""
    zero = F.lit(0).cast("long")
    steps = F.sequence(F.lit(0), F.size("chars") - F.when(F.col("root"), 1).otherwise(0))
    from_roots = roots.select(F.col("path").alias("labels"), F.col("path_chars").alias("chars"), F.lit(True).alias("root"), F.col("n_convs").alias("n"), "conv", "n_leaves", "saved_tokens", F.lit(None).cast("binary").alias("ends"))
    from_ended = ended.select("labels", "chars", F.lit(False).alias("root"), "n", "conv", zero.alias("n_leaves"), zero.alias("saved_tokens"), "ends")
    paths = from_roots.unionByName(from_ended)
    seen = paths.withColumn("depth", F.explode(steps)).select(
        _prefix("labels", "depth").alias("pre"), "depth", F.when(F.col("depth") > 0, F.get("chars", F.col("depth") - 1)).otherwise(0).cast("long").alias("chars"), "n", "conv", "n_leaves", "saved_tokens",
        F.when(~F.col("root") & (F.col("depth") == F.size("chars")), F.col("ends")).alias("ends"),
    )
    nodes = seen.groupBy("pre").agg(F.max("depth").alias("depth"), F.max("chars").alias("chars"), F.sum("n").alias("n_convs"), F.min("conv").alias("conv"), F.sum("n_leaves").alias("leaves_below"), F.sum("saved_tokens").alias("saved_below"), F.max("ends").alias("ends"))
    nodes = cut(nodes, "upper_levels")
    children = nodes.where("depth > 0").select(_prefix("pre", "depth - 1").alias("pre")).unionByName(roots.select(_prefix("path", "size(path_chars) - 1").alias("pre")))
    counted = nodes.join(children.groupBy("pre").agg(F.count(F.lit(1)).alias("n_children")), "pre", "left").withColumn("n_children", F.coalesce("n_children", zero))
    # each node's own part, and whether it is a leaf, for itself and every node above
    parts = counted.select("pre", ((F.col("n_convs") - 1) * F.col("chars")).alias("own"), (F.col("n_children") == 0).cast("long").alias("leaf"), F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("up"))
    sums = parts.groupBy(_prefix("pre", "up").alias("pre")).agg(F.sum("own").alias("own"), F.sum("leaf").alias("leaf"))
    whole = counted.join(sums, "pre")
    return whole.select("pre", F.col("depth").cast("long").alias("depth"), "conv", "n_convs", "n_children", (F.col("leaves_below") + F.col("leaf")).alias("n_leaves"), (F.col("saved_below") + F.col("own")).alias("saved_tokens"), "ends")


def trie(rows: DataFrame, limit: int = SHARD, chunk: int = CHUNK) -> DataFrame:
    """A row per node of the trie of rows (conv, labels, chars): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    rows = cut(rows.withColumn("key", F.md5("labels")), "sequences")
    seqs = rows.groupBy("key").agg(F.any_value("labels").alias("labels"), F.any_value("chars").alias("chars"), F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"))
    seqs = cut(seqs.join(hashed_ids(rows), "key"), "distinct_sequences")
    seqs = cut(sharded(seqs, limit), "sharded")
    nodes = cut(shard_nodes(seqs, chunk), "shard_nodes")
    roots = nodes.where("path is not null and depth > 0")
    upper = cut(upper_nodes(roots, seqs.where("cut_at is null")), "upper_nodes")

    columns = ("conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
    parents = upper.select("pre", F.col("conv").alias("above"))
    inner = nodes.where("path is null or depth = 0").select(*columns)
    of_roots = _looked_up(roots.withColumn("pre", _prefix("path", "depth - 1")), parents, "pre").withColumn("parent_conv", F.col("above")).select(*columns)
    of_upper = _looked_up(upper.withColumnRenamed("pre", "own").withColumn("pre", F.when(F.col("depth") > 0, _prefix("own", "depth - 1"))), parents, "pre").withColumn("parent_conv", F.col("above")).select(*columns)
    found = inner.unionByName(of_roots).unionByName(of_upper)
    return found.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce(F.lower(F.hex("ends")), F.lit(_NONE)).alias("ends_sha256"))
