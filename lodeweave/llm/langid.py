"""Language identification by rank-order profiles.

A text is lower-cased, every stretch without letters (or marks on them) becomes one blank, and its n-grams of one to
LONGEST characters are counted within words (with the blanks around them). A language's profile is the list of its most
frequent n-grams over all texts it is learned from; a document's profile is the same for the document. The out-of-place
distance adds, over the document's n-grams, how far each stands from its place in the language's list, and the list's
length where it is missing. The nearest language is the answer.

n-grams are sequences of whole code points of any script, coded as BITS-bit hashes; n-grams that share a code are counted
as one, so a language's counts are a fixed array whatever the script. Learning sums those arrays per task, then by
language and code in one shuffle. Profiles are a table, languages times `length` ranks. Identifying takes them BLOCK
languages at a time, which is all that is ever collected or broadcast; a table with more labels than that (a dirty
column) costs another pass for each further block, and the nearest so far goes along.

Cases: null texts and texts without a letter are `und` with score 0, and so is every text if nothing was learned;
null languages are not learned from; ties go to the first language in code point order; ids may be null or
repeated; an empty table gives an empty result. identify() keeps df's columns, text aside, in the struct `row`, so no
name clashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: n-grams in a profile; longest n-gram; bits of a code; languages that are compared in one pass (400 x 8 bytes each).
LENGTH, LONGEST, BITS, BLOCK = 400, 5, 16, 4096
CODES = 1 << BITS
#: Characters of a text whose n-grams are counted together; languages whose counts a task holds.
PART, HELD = 1 << 20, 64
_GOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """For each code point 2 for a letter, 1 for a mark, else 0."""
    return np.array([{"L": 2, "M": 1}.get(category(chr(cp))[0], 0) for cp in range(0x110000)], np.uint8)


def letters(text: str) -> np.ndarray:
    """Code points with one 0 between, before and after words; empty for a text without letters."""
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[cps]
    if not (kinds == 2).any():
        return cps[:0]
    codes = np.concatenate(([0], np.where(kinds > 0, cps, 0), [0])).astype(np.uint32)
    return codes[(codes > 0) | np.concatenate(([True], codes[:-1] > 0))]


def grams(c: np.ndarray) -> np.ndarray:
    """Codes of the n-grams of letters(): those of one letter, and longer ones without a blank inside."""
    h = (c.astype(np.uint64) + np.uint64(1)) * _GOLD
    blank = c == 0
    found, x, inner = [], h, np.zeros(len(c), bool)
    for n in range(1, LONGEST + 1):
        if n == 1:
            own = x[~blank]
        else:
            if n > 2:  # the one before the new last character is now inside
                inner = inner[:-1] | blank[n - 2 : len(c) - 1]
            else:
                inner = inner[:-1]
            x = (x[:-1] ^ (x[:-1] >> np.uint64(31))) * _MIX + h[n - 1 :]
            own = x[~inner]
        found.append((((own ^ (own >> np.uint64(29))) * _MIX) >> np.uint64(64 - BITS)).astype(np.uint16))
    return np.concatenate(found)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """n-gram codes of a text, ascending, and how often each stands there."""
    c = letters(text)
    if not len(c):
        return c, c
    if len(c) > PART:  # parts overlap by what an n-gram beyond the border needs
        counts = np.zeros(CODES, np.int64)
        for at in range(0, len(c), PART):
            counts += np.bincount(grams(c[at : at + PART + LONGEST - 1]), minlength=CODES)
            if at + PART < len(c):
                counts -= np.bincount(grams(c[at + PART : at + PART + LONGEST - 1]), minlength=CODES)
        codes = np.flatnonzero(counts)
        return codes, counts[codes]
    codes = np.sort(grams(c), kind="stable")
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.diff(first, append=len(codes))


def ranked(codes: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The most frequent codes, best first; of equals the smaller code first."""
    keys = (counts.astype(np.int64) << BITS) - codes
    if len(keys) > length:
        best = np.argpartition(-keys, length - 1)[:length]
        codes, keys = codes[best], keys[best]
    return codes[np.argsort(-keys, kind="stable")]


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", length: int = LENGTH) -> DataFrame:
    """Profiles (lang, codes): each language's n-gram codes by rank, from all rows with a language and a text."""
    schema = "lang string, code int, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in sums.items():
                codes = np.flatnonzero(counts).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int32()), pa.array(counts[codes], pa.int64())], ["lang", "code", "n"])
            sums.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, counts = counted(text)
                if lang not in sums:
                    if len(sums) >= HELD:
                        yield from out()
                    sums[lang] = np.zeros(CODES, np.int64)
                if len(codes):
                    sums[lang][codes] += counts
        yield from out()

    rows = df.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("lang is not null and text is not null")
    sums = rows.mapInArrow(run, schema).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = sums.withColumn("place", place).where(F.col("place") <= length).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("codes"))
    return cut(top.select("lang", F.transform("codes", lambda c: c["code"]).alias("codes")), "profiles")


class Profiles:
    """A block of languages: for each code the languages that list it and at which place."""

    def __init__(self, listed: list[tuple[str, list[int]]], length: int):
        listed = sorted(listed)
        self.names, self.length = [name for name, _ in listed], length
        codes = np.concatenate([np.array(c, np.int64) for _, c in listed]) if listed else np.zeros(0, np.int64)
        sizes = [len(c) for _, c in listed]
        order = np.argsort(codes, kind="stable")
        self.starts = np.searchsorted(codes[order], np.arange(CODES + 1))
        self.langs = np.repeat(np.arange(len(listed), dtype=np.int32), sizes)[order]
        self.places = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])[order] if listed else np.zeros(0, np.int32)

    def distances(self, top: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's ranked codes to each language."""
        a, n = self.starts[top], self.starts[top.astype(np.int64) + 1] - self.starts[top]
        upto = np.cumsum(n)
        at = np.repeat(a - upto + n, n) + np.arange(upto[-1] if len(n) else 0)
        nearer = self.length - np.abs(self.places[at] - np.repeat(np.arange(len(top)), n))
        saved = np.bincount(self.langs[at], np.maximum(nearer, 0), minlength=len(self.names))
        return self.length * len(top) - saved.astype(np.int64)


def identify(df: DataFrame, profiles: DataFrame, text_col: str = "text", length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """`row` (df's columns without its text), lang_pred and score: 1 less the distance over the largest possible."""
    spark = df.sparkSession
    kept = [c for c in df.columns if c != text_col]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(None).cast("int").alias("none"))
    docs = df.select(row.alias("row"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("double").alias("share"), F.col(f"`{text_col}`").cast("string").alias("text"))
    blocks = max(1, -(-profiles.count() // block))

    def passed(docs: DataFrame, number: int) -> DataFrame:
        own = profiles.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == number).collect()
        shared = spark.sparkContext.broadcast(Profiles([(r.lang, r.codes) for r in own], length))
        last = number + 1 == blocks
        schema = T.StructType(docs.schema.fields[: 3 if last else 4])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            languages = shared.value
            for batch in batches:
                names, shares = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                for i, text in enumerate(batch.column(3).to_pylist()):
                    codes, counts = counted(text) if text else ((), ())
                    if not len(codes) or not languages.names:
                        continue
                    top = ranked(codes, counts, length)
                    far = languages.distances(top)
                    best = int(far.argmin())
                    found = (float(far[best]) / (length * len(top)), languages.names[best])
                    if shares[i] is None or found < (shares[i], names[i]):
                        shares[i], names[i] = found
                columns = [batch.column(0), pa.array(names, pa.string()), pa.array(shares, pa.float64()), batch.column(3)]
                yield pa.RecordBatch.from_arrays(columns[: len(schema)], schema.names)

        return docs.mapInArrow(run, schema)

    for number in range(blocks):
        docs = passed(docs, number)
        if number + 1 < blocks:
            docs = cut(docs, "nearest_so_far")
    return docs.select("row", F.coalesce("best", F.lit("und")).alias("lang_pred"), F.coalesce(1 - F.col("share"), F.lit(0.0)).alias("score"))
