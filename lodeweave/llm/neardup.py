"""Near-duplicate documents by a multi-index Hamming join over b-bit MinHash signatures.

A document's set is its distinct w-word shingles. Its signature is HASHES symbols of 16 bits, each the hash of one
MinHash value; two sets of similarity s differ in about (1-s) * HASHES symbols. `radius` is the least number that
pairs at the wanted similarity exceed with probability below MISS. Signatures are split into radius // 2 + 1 chunks:
by pigeonhole a pair within the radius differs in at most one symbol of some chunk. So each chunk is entered once
per symbol with that symbol left out, which enumerates the allowed error, and all pairs within the radius meet in a
bucket. Every candidate pair is confirmed on the documents' full sets.

Texts with equal words are one class, found by grouping on a 128-bit hash and numbered; only classes enter the index.
Their texts are fetched by the classes' smallest ids and told apart by the same hash, one text a class. Within a
bucket pairs are not enumerated at once: first each member is compared to the bucket's smallest id. Confirmed links give components. Only buckets whose members are still
in different components are looked at again, in cells of bounded size, pair by pair across components, so no link
between components is lost, while a group of thousands of copies costs one comparison per member. A pair that meets
in several buckets is looked at in one only, which its signatures tell; members that still have a pair within the
radius bring their texts to the cell, and only links that were confirmed there leave it.

Connected components are found by alternating large-star and small-star steps on the links, with a checkpoint per
step. A step's least neighbours are combined per task, then written, so that the join back to the links meets two tables:
links are not shuffled while the least neighbours are small, and beyond that Spark splits a hot node's links (AQE).
Nothing that grows with the input reaches the driver but counts.

Cases: a null text, or one without words, has an empty set, is linked with nothing and is its own component; with
fewer words than w the whole sequence is the one shingle; rows that share an id are one document: each row counts with
its own set, whatever any of them is linked with is linked with the id, and all get the same component_id (rows of
equal words are compared once, however many there are); a null id has a null component_id and is kept; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

HASHES = 64
#: Chance that a pair just at the wanted similarity lies outside the radius.
MISS = 1e-6
#: Members and shingles of a cell side, about; a bucket of more is parted into blocks, and each pair of blocks is a cell.
CELL, CELL_SHINGLES = 2048, 4_000_000
#: Ids of texts to confirm (8 bytes each) that are broadcast at most to pick them from the table; beyond, they are joined.
MOST_BROADCAST = 500_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache
def radius(per_cent: int, hashes: int = HASHES, miss: float = MISS) -> int:
    """The least r with P(Binomial(hashes, 1 - per_cent/100) > r) below miss."""
    p, total = 1 - per_cent / 100, 0.0
    for r in range(hashes + 1):
        total += comb(hashes, r) * p**r * (1 - p) ** (hashes - r)
        if 1 - total < miss:
            return r
    return hashes


def chunks(r: int, hashes: int = HASHES) -> list[range]:
    """r // 2 + 1 near-equal stretches of symbols: r errors leave at most one in some stretch."""
    m = r // 2 + 1
    ends = [hashes * i // m for i in range(m + 1)]
    return [range(a, b) for a, b in zip(ends, ends[1:], strict=False)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * _GOLD


_words: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    known = _words
    try:
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(known) > 400_000:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def split_words(text: str) -> list[bytes]:
    """Words with A-Z lower-cased: bytes methods know ASCII letters and exactly the six white-space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a document's shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    h = _word_hashes(words)
    n = max(1, len(h) - width + 1)
    x = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for i in range(min(width, len(h))):
        x = _mixed(x * _GOLD + h[i : i + n])
    return np.unique(x)


_SEEDS = np.random.RandomState(7).randint(1, 2**31 - 1, (2, HASHES, 2)).astype(np.uint64)
_XOR = (_SEEDS[0, :, 0] << np.uint64(32)) | _SEEDS[0, :, 1]
_MUL = ((_SEEDS[1, :, 0] << np.uint64(33)) | (_SEEDS[1, :, 1] << np.uint64(1))) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES 16-bit symbols for each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)][:-1])
    out = np.empty((len(sets), HASHES), np.uint16)
    for k in range(HASHES):
        least = np.minimum.reduceat((flat ^ _XOR[k]) * _MUL[k], starts)
        out[:, k] = _mixed(least) >> np.uint64(48)
    return out


def bucket_keys(sigs: np.ndarray, r: int) -> np.ndarray:
    """For each signature one key per chunk and symbol of it left out."""
    keys = []
    wide = sigs.astype(np.uint64)
    for c, stretch in enumerate(chunks(r)):
        for gap in stretch:
            x = np.full(len(sigs), c * 1000 + gap, np.uint64)
            for i in stretch:
                if i != gap:
                    x = _mixed(x * _GOLD + wide[:, i] + np.uint64(1))
            keys.append(x)
    return np.stack(keys, axis=1).view(np.int64)


def _rows(columns: dict[str, tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def word_key(words: list[bytes]) -> str | None:
    """128-bit hash of the words; null without any."""
    from xxhash import xxh3_128_hexdigest

    return xxh3_128_hexdigest(b" ".join(words)) if words else None


def sketch(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, n_shingles, key (hash of the words; null without any), sig (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                keys, sizes, sets, places = [], [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    words = split_words(text)
                    found = shingles(words, width)
                    keys.append(word_key(words))
                    sizes.append(len(found))
                    if len(found):
                        sets.append(found)
                        places.append(i)
                sigs: list = [None] * len(keys)
                if sets:
                    for i, s in zip(places, signatures(sets), strict=True):
                        sigs[i] = s.tobytes()
                yield _rows({"id": (batch.column(0).to_pylist(), pa.int64()), "n_shingles": (sizes, pa.int64()), "key": (keys, pa.string()), "sig": (sigs, pa.binary())})

    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(f"`{text_col}`").alias("text")).mapInArrow(run, "id long, n_shingles long, key string, sig binary")


def _sig_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def buckets(classes: DataFrame, r: int) -> DataFrame:
    """bucket, gap (the symbol left out), id: every class in each of its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                keys = bucket_keys(_sig_matrix(batch.column(1)), r)
                gaps = np.tile(np.arange(HASHES, dtype=np.int8), len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(gaps), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), keys.shape[1]))], ["bucket", "gap", "id"])

    return classes.select("id", "sig").mapInArrow(run, "bucket long, gap byte, id long")


def _near(pairs: DataFrame, classes: DataFrame, r: int) -> DataFrame:
    """The pairs (a, b) whose signatures lie within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = (_sig_matrix(batch.column(2)) != _sig_matrix(batch.column(3))).sum(axis=1)
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(far <= r)).columns[:2], ["a", "b"])

    sigs = classes.select("id", "sig")
    both = pairs.join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b").join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def class_texts(ids: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """id, text: one text for each of these classes. rows: the documents' ids as `doc` and texts."""
    wanted = cut(ids.distinct().join(classes.select("id", "doc", "key"), "id"), "wanted_classes")
    docs = wanted.select("doc").distinct()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([word_key(split_words(t)) for t in batch.column(0).to_pylist()], pa.string()), batch.column(0)], ["key", "text"])

    found = rows.join(F.broadcast(docs) if wanted.count() <= MOST_BROADCAST else docs, "doc", "left_semi").select("text").mapInArrow(keyed, "key string, text string")
    return cut(found.join(wanted.select("id", "key"), "key").groupBy("id").agg(F.min("text").alias("text")), "class_texts")


def confirmed(pairs: DataFrame, classes: DataFrame, rows: DataFrame, width: int, per_cent: int) -> DataFrame:
    """The pairs of classes whose full sets reach the similarity. pairs: a cut table."""
    texts = class_texts(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), classes, rows)
    a, b = (texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            good = []
            for i, (x, text_x, text_y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if x != last:
                    last, held = x, shingles(split_words(text_x), width)
                other = shingles(split_words(text_y), width)
                common = len(np.intersect1d(held, other, assume_unique=True))
                if 100 * common >= per_cent * (len(held) + len(other) - common):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(good, pa.int64())) for c in batch.columns[:2]], ["a", "b"])

    joined = pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, component: the smallest id reachable, for every id in links(a, b) with a < b. Alternating large and small stars."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        # (u, v): large: every neighbour of u; small: neighbours not above u. Neighbours above u (or all) go to the least.
        if large:
            near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        else:
            near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = cut(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        moved = near.join(least, "u")
        if large:
            new = moved.where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            new = moved.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return cut(new.where(F.col("a") < F.col("b")).distinct(), "links")

    edges, before = links, None
    while True:
        edges = star(star(edges, True), False)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component"))


class _Cell:
    """Members of two blocks of a bucket: ids, components, blocks and signatures."""

    def __init__(self, items, i: int, j: int, gap: int, r: int):
        self.ids, self.comp, mine = (items.field(f).to_numpy(zero_copy_only=False) for f in ("id", "component", "mine"))
        self.sig = _sig_matrix(items.field("sig"))
        self.rows, self.cols, self.same = np.flatnonzero(mine == i), np.flatnonzero(mine == j), i == j
        self.gap, self.r, self.starts = gap, r, np.array([c.start for c in chunks(r)])
        self.chunk = int(np.searchsorted(self.starts, gap, side="right")) - 1

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """(x, ys): places of members in different components, within the radius, whose first common bucket this is."""
        first = self.gap == self.starts[self.chunk]
        for x in self.rows.tolist():
            y = self.cols[self.comp[self.cols] != self.comp[x]]
            if self.same:
                y = y[self.ids[y] > self.ids[x]]
            if not len(y):
                continue
            off = self.sig[y] != self.sig[x]
            good = off.sum(axis=1) <= self.r
            y, off = y[good], off[good]
            if not len(y):
                continue
            errors = np.add.reduceat(off, self.starts, axis=1, dtype=np.int16)
            here = errors[:, self.chunk]
            own = (errors[:, : self.chunk] >= 2).all(axis=1) & (((here == 0) & first) | ((here == 1) & off[:, self.gap]))
            if own.any():
                yield x, y[own]


def _open_cells(members: DataFrame, comps: DataFrame, classes: DataFrame, r: int) -> DataFrame:
    """bucket, gap, i, j, id, component, mine, sig: members that have a pair to be confirmed in a cell."""
    placed = members.join(comps, "id", "left").select("bucket", "gap", "id", F.coalesce("component", "id").alias("component"))
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    rows = placed.join(open_, "bucket").join(classes.select("id", "sig", "n_shingles"), "id")
    weights = rows.groupBy("bucket").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CELL), F.ceil(F.sum("n_shingles") / CELL_SHINGLES)).cast("int").alias("blocks"))
    rows = rows.join(weights, "bucket").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    single = rows.where("blocks = 1").withColumn("other", F.lit(0))
    several = rows.where("blocks > 1").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cells = single.unionByName(several).groupBy("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).agg(F.min("gap").alias("gap"), F.collect_list(F.struct("id", "component", "mine", "sig")).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                bucket, gap, i, j = (batch.column(c)[k].as_py() for c in range(4))
                items = batch.column(4)[k].values
                found: set[int] = set()
                for x, y in _Cell(items, i, j, gap, r).pairs():
                    found.add(x)
                    found.update(y.tolist())
                if found:
                    kept = items.take(pa.array(sorted(found)))
                    n = len(kept)
                    yield pa.RecordBatch.from_arrays([pa.array([bucket] * n), pa.array([gap] * n, pa.int8()), pa.array([i] * n, pa.int32()), pa.array([j] * n, pa.int32()), *(kept.field(f) for f in ("id", "component", "mine", "sig"))], ["bucket", "gap", "i", "j", "id", "component", "mine", "sig"])

    return cells.select("bucket", "gap", "i", "j", "items").mapInArrow(run, "bucket long, gap byte, i int, j int, id long, component long, mine int, sig binary")


def cell_links(members: DataFrame, comps: DataFrame, classes: DataFrame, rows: DataFrame, r: int, width: int, per_cent: int) -> DataFrame:
    """Links (a, b) between different components, enough to join all that any link joins."""
    open_ = cut(_open_cells(members, comps, classes, r), "open_cells")
    needed = class_texts(open_.select("id"), classes, rows)
    cells = open_.join(needed, "id").groupBy("bucket", "gap", "i", "j").agg(F.collect_list(F.struct("id", "component", "mine", "sig", "text")).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                gap, i, j = (batch.column(c)[k].as_py() for c in range(3))
                items = batch.column(3)[k].values
                cell = _Cell(items, i, j, gap, r)
                sets = [shingles(split_words(t), width) for t in items.field("text").to_pylist()]
                size = np.array([len(x) for x in sets])
                joined: set[tuple[int, int]] = set()
                links = []
                for x, ys in cell.pairs():
                    flat = np.concatenate([sets[y] for y in ys.tolist()])
                    at = np.minimum(np.searchsorted(sets[x], flat), size[x] - 1)
                    common = np.add.reduceat(sets[x][at] == flat, np.cumsum(size[ys]) - size[ys], dtype=np.int64)
                    for y in ys[100 * common >= per_cent * (size[x] + size[ys] - common)].tolist():
                        both = (min(cell.comp[x], cell.comp[y]), max(cell.comp[x], cell.comp[y]))
                        if both not in joined:
                            joined.add(both)
                            links.append((min(cell.ids[x], cell.ids[y]), max(cell.ids[x], cell.ids[y])))
                if links:
                    a, b = zip(*links, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return cells.select("gap", "i", "j", "items").mapInArrow(run, "a long, b long").distinct()


def link(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, per_cent: int = 85) -> DataFrame:
    """One row per input row: its id, n_shingles, component_id (the smallest id reachable) and kept (id = component_id)."""
    r = radius(per_cent)
    sketched = cut(sketch(df, id_col, text_col, width), "sketches")
    keyed = sketched.where("key is not null and id is not null")
    classes = keyed.groupBy("key").agg(F.min("id").alias("doc"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    entered = buckets(classes, r)
    shared = entered.groupBy("bucket").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(entered.join(shared.select("bucket", "hub"), "bucket"), "members")
    stars = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), text_of(f"`{text_col}`").alias("text"))
    links = confirmed(cut(_near(stars, classes, r), "near_stars"), classes, rows, width, per_cent)
    several = cut(sketched.where("id is not null").groupBy("id").agg(F.min(F.coalesce("key", F.lit(""))).alias("lo"), F.max(F.coalesce("key", F.lit(""))).alias("hi")).where("lo <> hi").select("id"), "ids_of_several_texts")
    has_several = bool(several.limit(1).count())
    if has_several:  # the classes of an id's rows are linked
        own = cut(keyed.select("id", "key").join(several, "id").select(F.col("id").alias("doc"), "key").distinct().join(classes.select("key", "id"), "key"), "rows_of_several")
        least = cut(own.groupBy("doc").agg(F.min("id").alias("a")), "least_of_several")
        links = links.unionByName(own.join(least, "doc").where("a <> id").select("a", F.col("id").alias("b")))
    comps = components(cut(links.distinct(), "star_links"))
    more = cut(cell_links(members, comps, classes, rows, r, width, per_cent), "cell_links")
    if more.limit(1).count():
        comps = components(comps.select(F.col("component").alias("a"), F.col("id").alias("b")).union(more))
    # classes in components, roots included, with the component's smallest document
    nodes = comps.unionByName(comps.select(F.col("component").alias("id"), "component").distinct())
    nodes = cut(nodes.join(classes.select("id", "doc"), "id"), "nodes")
    roots = cut(nodes.groupBy("component").agg(F.min("doc").alias("root")), "roots")
    of_class = classes.select("key", "id", "doc").join(nodes.select("id", "component").join(roots, "component").select("id", "root"), "id", "left").select("key", F.coalesce("root", "doc").alias("component"))
    out = sketched.join(of_class, "key", "left").select("id", "n_shingles", F.coalesce(F.when(F.col("id").isNotNull(), F.col("component")), F.col("id")).alias("component"))
    if has_several:  # rows without words go with their id's other rows
        out = cut(out, "rows_in_components")
        whole = cut(out.join(several, "id").groupBy("id").agg(F.min("component").alias("whole")), "components_of_several")
        out = out.join(whole, "id", "left").select("id", "n_shingles", F.coalesce("whole", "component").alias("component"))
    out = out.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, per_cent: int = 80) -> DataFrame:
    """df with one document of each group of near-duplicates, the one of the smallest id."""
    linked = link(df, id_col, text_col, width, per_cent)
    gone = linked.where(~F.col("kept")).select(F.col(id_col).alias("__gone")).distinct()
    return df.join(gone, F.col(f"`{id_col}`").cast("long") == F.col("__gone"), "left_anti")
