"""Vectors: cosine similarity, top-k with a threshold, and hashed text vectors."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeweave.functions.text import let
from lodeweave.operators.rules import words_of
from lodeweave.shared import cut

#: Rows of a block of a nearest search, about: a cell holds two blocks and their products.
BLOCK = 4096
#: Products that are looked at together.
CELLS = 1 << 18
#: Texts and words whose vectors are made together.
STEP_ROWS, STEP_WORDS = 1024, 1 << 18


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Within [-1, 1]; 0 for empty or zero vectors."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0) & (size > 1e-12), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size))).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector in doubles at length 1; a zero vector stays zero."""
    return let(a.cast("array<double>"), lambda v: let(norm(v), lambda size: F.transform(v, lambda x: F.when(size > 1e-12, x / size).otherwise(0.0))))


def _best_products(x: np.ndarray, y: np.ndarray, l_ids: np.ndarray, r_ids: np.ndarray, k: int, threshold: float, other_ids: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, product) of each row's k highest products at or above the threshold, best first, ties to the first of y;
    CELLS products are held at once."""
    parts, step = [], max(1, CELLS // len(y))
    for at in range(0, len(x), step):
        own = l_ids[at : at + step]
        sims = x[at : at + step] @ y.T
        np.clip(sims, -1, 1, out=sims)
        if other_ids:
            sims[own[:, None] == r_ids[None, :]] = -2
        # what reaches the k-th value, few but for ties
        least = np.partition(sims, -k, axis=1)[:, -k] if len(y) > k else np.full(len(own), -2.0)
        i, j = np.nonzero(sims >= np.maximum(least, max(threshold, -1))[:, None])
        s = sims[i, j]
        order = np.lexsort((j, -s, i))
        i, j, s = i[order], j[order], s[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
        parts.append((i[kept] + at, j[kept], s[kept]))
    rows, cols, found = (np.concatenate(p) for p in zip(*parts, strict=True))
    return rows, cols, found


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_vector: str, right_vector: str, k: int = 3, threshold: float = 0.0, block: int = BLOCK, other_ids: bool = False) -> DataFrame:
    """left_id, right_id, similarity, place: for each row of left the k most similar rows of right at or above the
    threshold, ties to the smaller id; with other_ids no row meets its own id.

    Both sides are brought to length 1 once and dealt to blocks of about `block` rows by hash; each pair of blocks is one
    group, scored as matrix products of bounded size, and its best k leave it. Empty and null vectors count as zero
    vectors, whose similarity is 0; vectors of different lengths never meet."""
    sides = [df.select(F.col(i).cast("long").alias("id"), F.coalesce(unit(F.col(v)), F.array().cast("array<double>")).alias("v")).withColumn("dim", F.size("v")) for df, i, v in ((left, left_id, left_vector), (right, right_id, right_vector))]
    n_left, n_right = (max(1, -(-df.count() // block)) for df in (left, right))
    ls = sides[0].withColumn("i", F.pmod(F.xxhash64("id"), F.lit(n_left)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))))
    rs = sides[1].withColumn("j", F.pmod(F.xxhash64("id"), F.lit(n_right)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        l_ids, r_ids = (t.column("id").to_numpy() for t in (a, b))
        rows, cols, found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(l_ids) and len(r_ids):
            by_id = np.argsort(r_ids, kind="stable")
            r_ids = r_ids[by_id]
            x, y = (np.asarray(t.column("v").combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1) for t in (a, b))
            rows, cols, found = _best_products(x, y[by_id], l_ids, r_ids, k, threshold, other_ids)
        return pa.table({"l_id": l_ids[rows], "r_id": r_ids[cols], "similarity": found})

    scored = ls.groupBy("dim", "i", "j").cogroup(rs.groupBy("dim", "i", "j")).applyInArrow(cell, "l_id long, r_id long, similarity double")
    place = F.row_number().over(Window.partitionBy("l_id").orderBy(F.desc("similarity"), "r_id"))
    return scored.withColumn("place", place.cast("long")).where(F.col("place") <= k).select(F.col("l_id").alias(left_id), F.col("r_id").alias(right_id), "similarity", "place")


def _slots(words: list[bytes], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Position and sign of each word: its SHA-256 number modulo 1536. 256 is 1 modulo 3 and 65536 is 1024 modulo 1536, so of all
    bytes but the last two only their sum modulo 3 counts."""
    if dims != 768:
        raise ValueError("the hash is worked out for 768 dimensions")
    digests = np.frombuffer(b"".join([sha256(w).digest() for w in words]), np.uint8).reshape(-1, 32)
    lead = digests[:, :30].sum(axis=1, dtype=np.int64) % 3
    r = (digests[:, 30].astype(np.int64) * 256 + digests[:, 31] + 1024 * lead) % (2 * dims)
    return r % dims, np.where(r < dims, 1.0, -1.0)


def _hashed(word: Column, dims: int) -> Column:
    """struct(pos, sign) of a word."""

    @F.arrow_udf("struct<pos:bigint,sign:double>")
    def run(words: pa.Array) -> pa.Array:
        held = words.dictionary_encode()  # most words come back
        pos, sign = _slots(held.dictionary.cast(pa.binary()).to_pylist(), dims)
        at = held.indices.to_numpy()
        return pa.StructArray.from_arrays([pa.array(pos[at]), pa.array(sign[at])], ["pos", "sign"])

    return run(word)


def hash_embedding(df: DataFrame, id_col: str, text_col: str, dims: int = 768) -> DataFrame:
    """id, pos, value: unit-length sparse vector of hashed words (weight by place) and neighbouring pairs (half)."""
    w = df.select(F.col(id_col).alias("id"), words_of(F.lower(F.coalesce(F.col(text_col), F.lit("")))).alias("w"))
    ones = F.transform("w", lambda x, i: F.struct(x.alias("t"), (1 / F.log2(i + 3)).alias("weight")))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.struct(F.concat_ws("_", a, b).alias("t"), F.lit(0.5).cast("double").alias("weight")))).otherwise(F.array().cast("array<struct<t:string,weight:double>>"))
    terms = w.select("id", F.explode(F.concat(ones, pairs)).alias("x")).select("id", _hashed(F.col("x.t"), dims).alias("h"), F.col("x.weight").alias("weight"))
    sums = terms.groupBy("id", F.col("h.pos").alias("pos")).agg(F.sum(F.col("h.sign") * F.col("weight")).alias("value"))
    total = sums.groupBy("id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("size"))
    return sums.join(total, "id").select(F.col("id").alias(id_col), "pos", F.when(F.col("size") > 0, F.col("value") / F.col("size")).otherwise(0.0).alias("value"))


def sync(known: DataFrame, texts: DataFrame, key: str, text_col: str) -> DataFrame:
    """Sparse vectors of the keys that `known` lacks."""
    return hash_embedding(texts.join(known.select(key).distinct(), key, "left_anti"), key, text_col)


def dense(sparse: DataFrame, id_col: str, dims: int = 768) -> DataFrame:
    """id, embedding (array of dims) from id, pos, value."""
    held = sparse.groupBy(id_col).agg(F.collect_list("pos").alias("pos"), F.collect_list("value").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos = batch.column(1)
            flat = np.zeros(batch.num_rows * dims)
            row = np.repeat(np.arange(batch.num_rows), np.diff(pos.offsets.to_numpy()))
            flat[row * dims + pos.flatten().to_numpy(zero_copy_only=False)] = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            made = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dims), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], [id_col, "embedding"])

    return held.mapInArrow(run, T.StructType([held.schema[id_col], T.StructField("embedding", T.ArrayType(T.DoubleType()))]))


def taxonomy_vectors(options: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """option, embedding of a taxonomy's options(option, description); those that known(option, embedding) has are not made anew."""
    todo = options if known is None else options.join(known.select("option"), "option", "left_anti")
    made = dense(hash_embedding(todo, "option", "description"), "option")
    return made if known is None else known.select("option", "embedding").unionByName(made)


def _embedded(offsets: np.ndarray, words: pa.Array, dims: int) -> np.ndarray:
    """The vectors of hash_embedding, a row for each text; text i has words[offsets[i]:offsets[i + 1]]."""
    held = words.dictionary_encode()
    names, code = held.dictionary.cast(pa.binary()).to_pylist(), held.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    weight = 1 / (np.log(np.arange(len(row)) - offsets[row] + 3) / np.log(2))
    next_to = np.flatnonzero(row[1:] == row[:-1])
    pairs, which = np.unique(code[next_to] * len(names) + code[next_to + 1], return_inverse=True)
    first, second = np.divmod(pairs, max(1, len(names)))
    pos, sign = _slots([*names, *[names[a] + b"_" + names[b] for a, b in zip(first.tolist(), second.tolist(), strict=True)]], dims)
    term = np.concatenate([code, len(names) + which])
    at = np.concatenate([row, row[next_to]]) * dims + pos[term]
    sums = np.bincount(at, sign[term] * np.concatenate([weight, np.full(len(next_to), 0.5)]), (len(offsets) - 1) * dims).reshape(-1, dims)
    size = np.sqrt(np.einsum("ij,ij->i", sums, sums))[:, None]
    return np.divide(sums, size, out=np.zeros_like(sums), where=size > 1e-12)


def _vectors_of(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, vectors) of batches of ids and lists of words, STEP_ROWS rows and about STEP_WORDS words at a time; texts without words
    have none."""
    for batch in batches:
        batch = batch.filter(pc.greater(pc.list_value_length(batch.column(1)), 0))
        offsets, at = batch.column(1).offsets.to_numpy().astype(np.int64), 0
        while at < batch.num_rows:
            end = max(at + 1, min(at + STEP_ROWS, int(np.searchsorted(offsets, offsets[at] + STEP_WORDS, "right")) - 1))
            words = batch.column(1).values.slice(offsets[at], offsets[end] - offsets[at])
            yield batch.column(0).slice(at, end - at), _embedded(offsets[at : end + 1] - offsets[at], words, dims)
            at = end


def match_texts(texts: DataFrame, id_col: str, text_col: str, options: DataFrame, threshold: float = 0.0, dims: int = 768) -> DataFrame:
    """id, option, similarity: the taxonomy's option (with its embedding) nearest to each text, at or above the threshold; texts of one
    id count as one.

    A text's vector is made in the task that reads it and meets the options there, if they fit a block of a nearest search; else
    the vectors are written and searched by blocks. Only texts that share an id are shuffled."""
    numbered = options.withColumn("n", F.xxhash64("option"))
    usable = numbered.where(F.size("embedding") == dims).select("n", "option", F.col("embedding").cast("array<double>").alias("embedding"))
    few = usable.limit(BLOCK + 1).toArrow()
    fits = few.num_rows <= BLOCK
    words = texts.select(F.col(id_col).cast("long").alias(id_col), words_of(F.lower(F.coalesce(F.col(text_col), F.lit("")))).alias("w"))
    shared = cut(texts.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(id_col), "shared_ids")
    several = not shared.isEmpty()
    if several:
        words = words.join(shared.select(F.col(id_col).cast("long").alias(id_col)), id_col, "left_anti")
    few = few.sort_by("n")
    names, y = few.column("option").combine_chunks(), np.asarray(few.column("embedding").combine_chunks().flatten(), np.float64).reshape(-1, dims)
    size = np.sqrt(np.einsum("ij,ij->i", y, y))[:, None]
    y = np.divide(y, size, out=np.zeros_like(y), where=size > 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _vectors_of(batches, dims):
            if len(y):
                # what differs by the order of adding only is equal, and goes to the first
                sims = np.clip(np.round(x @ y.T, 12), -1, 1) + 0.0
                best = sims.argmax(axis=1)
                found = sims[np.arange(len(x)), best]
                kept = np.flatnonzero(found >= max(threshold, -1))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(kept)), names.take(pa.array(best[kept])), pa.array(found[kept])], [id_col, "option", "similarity"])

    def vectors_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _vectors_of(batches, dims):
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dims), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([ids, made], [id_col, "embedding"])

    def by_blocks(own: DataFrame) -> DataFrame:
        best = nearest(cut(own, "text_vectors"), numbered, id_col, "n", "embedding", "embedding", 1, threshold)
        return best.join(numbered.select("n", "option"), "n").select(id_col, "option", "similarity")

    found = words.mapInArrow(run, f"{id_col} long, option string, similarity double") if fits else by_blocks(words.mapInArrow(vectors_only, f"{id_col} long, embedding array<double>"))
    if several:
        found = found.unionByName(by_blocks(dense(hash_embedding(texts.join(shared, id_col, "left_semi"), id_col, text_col, dims), id_col, dims)))
    return found
