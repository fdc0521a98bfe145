"""Exact top-k inner-product search over an impact-ordered, score-at-a-time index.

Vectors are rounded down to whole numbers, floor(scale * x). A block of them is indexed as postings (row, component),
one list per dimension and impact level; a component's impact is its size, quantised to levels that fall by the square
root of two. Queries work through the levels from the highest impact down, all lists of a level adding the query's
component times theirs to the scores so far; components of lower levels are not touched. After a level, a row's unseen
rest adds to its score at most the lesser of the unseen length times the query's length (Cauchy-Schwarz) and the
level's lower limit times the query's sum of sizes. The k rows with the best scores so far are scored exactly: the k-th
of them is a score that members must reach. As soon as few rows can still reach it - `few` times k, or all that is left
when every level was read - a query stops, on that proof and on its own; those possible members are scored exactly, as
whole numbers, and only exact scores leave the block.

Levels are read one by one on a sample of the block's rows. Only where the sample says that a query may stop are the lists of
all rows added, those of all its levels in one matrix product, and the proof is tried on all rows; a query whose proof fails reads
on to the last level. Rows are looked at by the best score of their chunk first, which leaves few chunks to compare row by row.

Each vector goes to one block and is shuffled once; each query goes to every block. A block holds about COMPONENTS
components and CELLS scores of one group of queries, so blocks are as few as memory allows; their queries stream past `group`
at a time, after the block's vectors, in one sorted pass. What is looked at beyond the scores themselves - possible members, their
bounds and exact scores - is worked out SLICE numbers at a time. The best k of each block are merged per query, pre-ranked before the shuffle. Nothing is
collected but two counts, nothing is broadcast.

Cases: null vectors, null or non-finite components, and null ids take no part; vectors of different lengths never
meet; rows that repeat an id count once, with the smallest of their vectors; a query never finds its own id; ties go
to the smaller id; fewer candidates than k give fewer rows; an empty table gives none. Components or scores that int64
does not hold are worked out as Python integers; a score beyond a long cannot be returned and raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Components of a block, about; rows that are worth a block of their own if cores are idle; queries that stream past together.
COMPONENTS, LEAST_ROWS, GROUP = 1 << 22, 4096, 256
#: Scores (rows times queries of a group) that a block holds, and those that are looked at together.
CELLS, SLICE = 1 << 24, 1 << 20
#: Components of the rows that are looked at level by level, and rows of a chunk, whose best score is looked at first.
SAMPLE, CHUNK = 1 << 17, 64
#: Layouts of lists that are kept for the next group, each of a block's size.
LAID = 4
#: A query stops once at most so many times k rows can still be members.
FEW = 8


def whole_numbers(flat: np.ndarray, width: int, scale: float) -> np.ndarray:
    """Rows of floor(scale * x); Python integers where int64 does not hold them."""
    whole = np.floor(flat * scale)
    if len(whole) and np.abs(whole).max() >= 2**62:
        whole = np.array([int(x) for x in whole.tolist()], object)
    else:
        whole = whole.astype(np.int64)
    return whole.reshape(-1, width)


class Block:
    """The impact-ordered index of some vectors, in ascending order of id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.exact = ids, vectors
        values = vectors.astype(np.float64)
        self.n, self.width = values.shape
        size = np.abs(values)
        self.top = float(size.max(initial=0))
        #: Lower limits of the levels, the last one takes all that is not 0.
        self.limits = [self.top]
        while self.limits[-1] > 1:
            self.limits.append(max(1.0, self.limits[-1] / 2**0.5))
        self.limits = self.limits[1:] if len(self.limits) > 1 else self.limits
        del size
        flat = values.ravel()
        place = np.flatnonzero(flat)
        values = flat[place]
        rows, dims = (place // self.width).astype(np.int32), (place % self.width).astype(np.int32)
        del flat, place
        level = np.searchsorted(-np.array(self.limits), -np.abs(values), side="left") if self.top else np.zeros(0, np.int64)
        key = (np.minimum(level, len(self.limits) - 1) * self.width + dims).astype(np.int32)
        del level, dims
        order = np.argsort(key, kind="stable")
        self.rows, self.values = rows[order], values[order]
        self.starts = np.searchsorted(key[order], np.arange(len(self.limits) * self.width + 1, dtype=np.int32))
        del order, key
        rest = np.bincount(rows, values * values, minlength=self.n)
        #: Length of what is unseen of each row after each level.
        self.left = []
        for i in range(len(self.limits)):
            a, z = self.starts[i * self.width], self.starts[(i + 1) * self.width]
            rest = np.maximum(rest - np.bincount(self.rows[a:z], self.values[a:z] ** 2, minlength=self.n), 0)
            self.left.append(np.sqrt(rest))
        self.left[-1] = np.zeros(self.n)
        #: Rows that are looked at level by level, before all are, and the levels of their components.
        self.some = min(self.n, max(1, SAMPLE // max(1, self.width)))
        self.sample = vectors[: self.some].astype(np.float64)
        self.sample_level = np.minimum(np.searchsorted(-np.array(self.limits), -np.abs(self.sample), side="left"), len(self.limits) - 1)
        self.sample_level[self.sample == 0] = len(self.limits)
        self.rooms = max(1, -(-self.n // CHUNK))
        self._laid: dict = {}
        #: Postings that queries have read, and what full scans would have read.
        self.read = self.scanned = 0

    def _lists(self, upto: int, real: type) -> np.ndarray:
        """The lists of the first levels side by side, (rows, dimensions): one matrix product adds them all to the scores of a group."""
        if (upto, real) not in self._laid:
            while len(self._laid) >= LAID:
                del self._laid[next(iter(self._laid))]
            end = self.starts[upto * self.width]
            laid = np.zeros((self.rooms * CHUNK, self.width), real)
            dims = np.repeat(np.tile(np.arange(self.width, dtype=np.int32), upto), np.diff(self.starts[: upto * self.width + 1]))
            laid[self.rows[:end], dims] = self.values[:end]
            self._laid[upto, real] = laid
        return self._laid[upto, real]

    def _settle(self, rows: np.ndarray, cols: np.ndarray, score, k: int, held: list) -> list:
        """held, (query, row, exact score) of each query's best k so far, with further pairs looked at."""
        step = max(1, SLICE // max(1, self.width))
        for at in range(0, len(rows), step):
            r, c = rows[at : at + step], cols[at : at + step]
            r, c, x = (np.concatenate(pair) for pair in zip(held, (r, c, score(r, c)), strict=True)) if held else (r, c, score(r, c))
            order = np.argsort(c, kind="stable")
            order = order[np.argsort(-x[order], kind="stable")]
            order = order[np.argsort(r[order], kind="stable")]
            r, c, x = r[order], c[order], x[order]
            kept = np.arange(len(r)) - np.searchsorted(r, r, side="left") < k
            held = [r[kept], c[kept], x[kept]]
        return held

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, few: int = FEW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, id, score) of each query's best k of this block, best first."""
        q = queries.astype(np.float64)
        most = self.top * np.abs(q).max(initial=0) * max(1, self.width)
        real, slack = (np.float32, 1.0) if most < 2**23 else (np.float64, 1.0 + most * 1e-9)
        exact_q, exact_v = (queries, self.exact) if most < 2**62 else (queries.astype(object), self.exact.astype(object))
        score = lambda rows, cols: (exact_q[rows] * exact_v[cols]).sum(axis=1)
        length, total = np.sqrt((q * q).sum(axis=1)), np.abs(q).sum(axis=1)
        own = np.searchsorted(self.ids, query_ids)
        own[(own < self.n) & (self.ids[np.minimum(own, self.n - 1)] != query_ids)] = self.n
        asked = q.astype(real)
        self.scanned += len(self.rows) * len(q)
        few_here = max(2, few * k * self.some // max(1, self.n))
        place = min(max(1, k * self.some // max(1, self.n)), max(1, self.some))
        sample = np.zeros((len(q), self.some), real)
        whole = self.some == self.n
        live, tried, held = np.arange(len(q)), np.zeros(len(q), bool), []
        for i, limit in enumerate(self.limits):
            last = i + 1 == len(self.limits)
            ready = live
            if whole or (not last and self.some > place):  # what a sample of the rows says: whether it is worth while to look at all of them
                lists = np.where(self.sample_level == i, self.sample, 0).astype(real)
                sample[live] += asked[live] @ lists.T
                inside = live[own[live] < self.some]
                sample[inside, own[inside]] = -np.inf
                bound = np.minimum(self.left[i][: self.some] * length[live, None], limit * total[live, None]) + slack
                near = -np.partition(-sample[live], place - 1, axis=1)[:, place - 1]
                self.read += np.count_nonzero(lists) * len(live)
                if not last:
                    ready = live[((sample[live] + bound >= near[:, None]).sum(axis=1) <= few_here) & (whole | ~tried[live])]
                    if not whole and (i % 2 or 4 * len(ready) < len(live)):  # lists are laid out for many queries at once
                        continue
            elif not last:
                continue
            tried[ready] = True
            ended = []
            for at in range(0, len(ready), max(1, CELLS // max(1, self.n))):
                ended.append(self._stopped(ready[at : at + max(1, CELLS // max(1, self.n))], i, last, asked, own, length, limit * total, slack, score, k, few * k, held, sample if whole else None))
            live = np.setdiff1d(live, np.concatenate(ended)) if ended else live
            if not len(live):
                break
        if not held:
            return (np.zeros(0, np.int64),) * 3
        rows, cols, scores = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(rows, kind="stable")
        return rows[order], self.ids[cols[order]], scores[order]

    def _stopped(self, some: np.ndarray, i: int, last: bool, asked: np.ndarray, own: np.ndarray, length: np.ndarray, by_sum: np.ndarray, slack: float, score, k: int, most: int, held: list, known: np.ndarray | None) -> np.ndarray:
        """Those of some queries that stop after level i, on a proof over all rows; their best k are put into held. known: scores so far."""
        if known is None:
            partial = asked[some] @ self._lists(i + 1, asked.dtype.type).T
            self.read += int(self.starts[(i + 1) * self.width]) * len(some)
            partial[:, self.n :] = -np.inf
        else:
            partial = np.full((len(some), self.rooms * CHUNK), -np.inf, known.dtype)
            partial[:, : self.n] = known[some]
        inside = np.flatnonzero(own[some] < self.n)
        partial[inside, own[some][inside]] = -np.inf
        rooms = partial.reshape(len(some), self.rooms, CHUNK)
        tops = rooms.max(axis=2)
        # the k best so far lie in the k chunks with the highest tops; exact scores of them are a floor
        best = np.argpartition(-tops, k - 1, axis=1)[:, :k] if self.rooms > k else np.tile(np.arange(self.rooms), (len(some), 1))
        cells = np.take_along_axis(rooms, best[:, :, None], axis=1).reshape(len(some), -1)
        floor = np.full(len(some), -np.inf)
        if self.n >= k and cells.shape[1] >= k:
            inner = np.argpartition(-cells, k - 1, axis=1)[:, :k] if cells.shape[1] > k else np.tile(np.arange(k), (len(some), 1))
            cols = np.take_along_axis(best, inner // CHUNK, axis=1) * CHUNK + inner % CHUNK
            real_rows = ~np.isneginf(np.take_along_axis(cells, inner, axis=1))
            exact = score(np.repeat(some, k), np.minimum(cols, self.n - 1).ravel()).astype(np.float64).reshape(len(some), k)
            floor = np.where(real_rows, exact, -np.inf).min(axis=1)
        left, by_sum = np.zeros(self.rooms * CHUNK), np.zeros(len(some)) if last else by_sum[some]
        left[: self.n] = self.left[i]
        left = left.reshape(self.rooms, CHUNK)
        least = floor - slack
        widest = np.minimum(left.max(axis=1)[None, :] * length[some, None], by_sum[:, None]) + slack
        who, room = np.nonzero((tops + widest * 1.000001 >= least[:, None]) & ~np.isneginf(tops))

        def possible(who: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(query, row) of the rows of some chunks that may be members."""
            cells = rooms[who, room]
            bound = np.minimum(left[room] * length[some][who, None], by_sum[who, None]) + slack
            at, inner = np.nonzero((cells + bound * 1.000001 >= least[who, None]) & ~np.isneginf(cells))
            return who[at], room[at] * CHUNK + inner

        done = np.ones(len(some), bool)
        step = max(1, SLICE // CHUNK)
        if not last:
            counts = np.zeros(len(some), np.int64)
            for at in range(0, len(who), step):
                counts += np.bincount(possible(who[at : at + step], room[at : at + step])[0], minlength=len(some))
            done = counts <= most
            who, room = who[done[who]], room[done[who]]
        found: list = []
        for at in range(0, len(who), step):
            rows, cols = possible(who[at : at + step], room[at : at + step])
            found = self._settle(some[rows], cols, score, k, found)
        if found:
            held.append(found)
        return some[done]


def search(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, block: int | None = None, group: int = GROUP) -> DataFrame:
    """query_id, rank (from 1), the id of the vector under id_col, score: each query row's best k among all other rows.

    is_query: a condition on id_col. block: rows of a block, about.
    """
    spark = df.sparkSession
    vector = F.col(f"`{vector_col}`")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), is_query.alias("asks"), vector.cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks")).withColumn("dim", F.size("v")).where("dim > 0")
    rows = cut(rows, "topk_vectors")
    n, width = rows.agg(F.count(F.lit(1)), F.max("dim")).first()
    if block is None:
        idle = -(-n // LEAST_ROWS)
        most = max(1, min(COMPONENTS // (width or 1), CELLS // group))
        block = max(1, -(-n // max(1, -(-n // most), min(idle, spark.sparkContext.defaultParallelism))))
    blocks = max(1, -(-n // block))
    placed = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    vectors = rows.select("dim", placed.alias("b"), F.lit(0).alias("kind"), "id", "v")
    queries = rows.where("asks").select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(1).alias("kind"), "id", "v")
    dealt = vectors.unionByName(queries).repartition(blocks, "dim", "b").sortWithinPartitions("dim", "b", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, index, asked = None, [], None, []

        def part(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            return batch.column(3).to_numpy(), whole_numbers(np.asarray(batch.column(4).flatten(), np.float64), cell[0], scale)

        def joined(parts: list) -> tuple[np.ndarray, np.ndarray]:
            ids, numbers = zip(*parts, strict=True)
            return np.concatenate(ids), np.concatenate(numbers)

        def ask() -> Iterator[pa.RecordBatch]:
            nonlocal index, held, asked
            if asked and held:
                index, held = Block(*joined(held)), []
            if asked and index is not None:
                ids, numbers = joined(asked)
                for at in range(0, len(ids), group):
                    rows, found, scores = index.search(numbers[at : at + group], ids[at : at + group], k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + group][rows]), pa.array(found), pa.array(scores.tolist(), pa.int64())], ["query_id", "id", "score"])
            asked = []

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))).tolist()
            for a, z in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                if cell != tuple(keys[a, :2].tolist()):
                    yield from ask()
                    cell, held, index = tuple(keys[a, :2].tolist()), [], None
                (asked if keys[a, 2] else held).append(part(batch.slice(a, z - a)))
                if sum(len(ids) for ids, _ in asked) >= group:
                    yield from ask()
        yield from ask()

    found = dealt.mapInArrow(run, "query_id long, id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
